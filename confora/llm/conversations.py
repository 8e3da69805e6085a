"""Repair of conversation structure: the cheapest edits after which roles read ``(s?(ua)+)?``.

Rows of a conversation are taken by turn (nulls first; equal turns by role, then by digest of the row, so that equal rows are
adjacent). A row's first fault counts: blank, duplicate (role and text seen earlier in the conversation) or truncated (its
last character that is not white space is none of ``.!?``). Edits: Keep 0, Rerole to user or assistant 2, Delete 3 (the only
one for blank and duplicate rows), Insert an empty user or assistant turn anywhere 2; a truncated row that stays adds 1.
Of the cheapest edits the ASCII-least string of initials is taken.

A forward Viterbi over four states (nothing yet, after a system, user or assistant turn) carries for each state the least (cost, audit
string). After each row, the layer is closed by at most two inserts. Audit strings before closing end in their row's letter, so none is the
beginning of another: their order never changes by what follows. A layer thus keeps the strings' ranks and one byte of
back pointer for each state, and the string is read off backwards.

Long conversations are cut by turn into chunks of ``CHUNK``. A chunk's task gives the least (cost, letters) from each
of the four states it may begin in to each it may end in; chunks are then joined by costs and ranks alone, one row each. Decoding
sees no texts: faults are found on digests. Texts are shuffled once, by chunk, when edits are applied to them.

Nulls in role and text are one space. Null turns, and turns below ``CHUNK``, are the first chunk; a null id is a conversation of its
own. Repeated rows are duplicates. Empty tables give empty results. Other columns are ignored. Limit: rows of one chunk are streamed through one task (four
bytes a row are held), so a single turn with very many rows is not split; a digest over a whole conversation is sequential by nature.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import renamed, written

#: Turns of a chunk.
CHUNK = 4096
SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 2, 3, 2, 1
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: States: 0 nothing yet, 1 after a system turn, 2 after a user turn, 3 after an assistant turn. Where the initial of a turn leads.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTED = (0, 3)
#: What a turn that is made or reroled must be, by the state before it, and the state after it.
TURN = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
#: Inserts that close a layer: (state after, letters).
CLOSING = (((0, ""), (2, "I"), (3, "II")), ((1, ""), (2, "I"), (3, "II")), ((2, ""), (3, "I")), ((3, ""), (2, "I")))
LETTERS = [i + x for i in ("", "I", "II") for x in "DKR"]
CODE = {x: i for i, x in enumerate(LETTERS)}


def closed(layer: dict) -> dict:
    """{state: (cost, rank, state before, inserts)} of a layer {state: (cost, rank)}, each the least."""
    best = {}
    for at, (cost, rank) in layer.items():
        for to, letters in CLOSING[at]:
            found = (cost + INSERT * len(letters), rank, at, letters)
            if to not in best or found < best[to]:
                best[to] = found
    return best


class Lattice:
    """The forward layers of one chunk from one state."""

    def __init__(self, start: int):
        self.start, self.layer, self.back = start, {start: (0, 0)}, bytearray()

    def add(self, initial: str, fault: int) -> None:
        best: dict = {}

        def offer(to, cost, rank, letters, at):
            found = (cost, rank, letters, at)
            if to not in best or found < best[to]:
                best[to] = found

        for q, (cost, rank, at, inserts) in closed(self.layer).items():
            offer(q, cost + DELETE, rank, inserts + "D", at)
            if fault not in (BLANK, DUPLICATE):
                stays = cost + UNFINISHED * (fault == TRUNCATED)
                if initial in GRAMMAR[q]:
                    offer(GRAMMAR[q][initial], stays + KEEP, rank, inserts + "K", at)
                offer(TURN[q][1], stays + REROLE, rank, inserts + "R", at)
        order = sorted(best, key=lambda q: best[q][1:3])
        self.layer = {q: (best[q][0], i) for i, q in enumerate(order)}
        pointers = bytearray(4)
        for q, (_, _, letters, at) in best.items():
            pointers[q] = at * len(LETTERS) + CODE[letters]
        self.back += pointers

    def ends(self) -> list[dict]:
        """(start, end, cost, letters) of every state that the last layer reaches."""
        out = []
        for end, (cost, _) in self.layer.items():
            q, parts = end, []
            for i in range(len(self.back) - 4, -4, -4):
                q, code = divmod(self.back[i + q], len(LETTERS))
                parts.append(LETTERS[code])
            out.append({"start": self.start, "end": end, "cost": cost, "letters": "".join(reversed(parts))})
        return out


def joined(chunks: list[list[dict]]) -> tuple[int, list[tuple[int, str]]]:
    """(cost, [(state before, letters) of each chunk]) of the least way through a conversation's chunks."""
    layer, steps = {0: (0, 0)}, []
    for paths in chunks:
        best: dict = {}
        for p in paths:
            if p["start"] in layer:
                cost, rank = layer[p["start"]]
                found = (cost + p["cost"], rank, p["letters"], p["start"])
                if p["end"] not in best or found < best[p["end"]]:
                    best[p["end"]] = found
        order = sorted(best, key=lambda q: best[q][1:3])
        layer = {q: (best[q][0], i) for i, q in enumerate(order)}
        steps.append({q: (b[3], b[2]) for q, b in best.items()})
    cost, _, at, last = min(found for q, found in closed(layer).items() if q in ACCEPTED)
    out = []
    for step in reversed(steps):
        at, letters = step[at]
        out.append((at, letters))
    out.reverse()
    out[-1] = (out[-1][0], out[-1][1] + last)
    return cost, out


PATHS = "array<struct<start: int, end: int, cost: long, letters: string>>"
COUNTS = ("blank", "duplicate", "truncated", "illegal", "n_turns")


def groups(batches, key: int):
    """(key, rows) of consecutive rows whose first ``key`` columns agree; rows come as they are read and must be used up in turn."""
    from itertools import groupby

    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    return groupby(rows, key=lambda r: r[:key])


def legal(left: str, right: str) -> bool:
    return left + right in ("su", "ua", "au")


def chunk_paths(batches):
    out, size = [], 0
    for (conv, chunk), rows in groups(batches, 2):
        lattices = [Lattice(0)] if chunk == 0 else [Lattice(s) for s in range(4)]
        n = dict.fromkeys(COUNTS, 0)
        first = last = turn = low = high = None
        for _, _, turn, initial, fault in rows:
            for x in lattices:
                x.add(initial, fault)
            if fault:
                n[COUNTS[fault - 1]] += 1
            n["illegal"] += last is not None and not legal(last, initial)
            if turn is not None and turn != high:
                n["n_turns"] += 1
                low, high = turn if low is None else low, turn
            first, last = initial if first is None else first, initial
        paths = [p for x in lattices for p in x.ends()]
        out.append((conv, chunk, first, last, low, high, *n.values(), paths))
        size += sum(len(p["letters"]) for p in paths)
        if size > 1 << 22 or len(out) >= 5000:
            yield out
            out, size = [], 0
    if out:
        yield out


def chunk_joins(batches):
    out, size = [], 0
    for (conv,), rows in groups(batches, 1):
        n, low, high, last, number, paths = dict.fromkeys(COUNTS, 0), None, None, None, [], []
        for _, chunk, first, final, least, most, *counts, found in rows:
            for name, k in zip(COUNTS, counts):
                n[name] += k
            n["illegal"] += last is not None and not legal(last, first)
            low, high, last = least if low is None else low, high if most is None else most, final
            number.append(chunk)
            paths.append(found)
        cost, steps = joined(paths)
        gaps = 0 if low is None else high - low + 1 - n["n_turns"]
        pieces = [{"chunk": c, "state": s, "letters": x} for c, (s, x) in zip(number, steps)]
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], n["illegal"], cost, "".join(x for _, x in steps), pieces))
        size += len(out[-1][-2])
        if size > 1 << 22 or len(out) >= 5000:
            yield out
            out, size = [], 0
    if out:
        yield out


def edited(batches):
    """The repaired rows of each chunk: its plan comes first, then its rows in order."""
    out, size = [], 0
    for (conv, chunk), rows in groups(batches, 2):
        _, _, _, state, _, letters = next(rows)
        at, position = 0, 0
        rest = ((r, t) for _, _, _, _, r, t in rows)
        while at < len(letters):
            x, at = letters[at], at + 1
            role, text = ("", "") if x == "I" else next(rest)
            if x == "D":
                continue
            if x == "K":
                state = GRAMMAR[state][role[0]]
            else:
                role, state = TURN[state]
            out.append((conv, chunk, position, x, role, text))
            position, size = position + 1, size + len(text)
            if size > 1 << 23 or len(out) >= 10_000:
                yield out
                out, size = [], 0
    if out:
        yield out


def hashed(batches):
    """The digest of each conversation's repaired rows, fed row by row."""
    out = []
    for (conv,), rows in groups(batches, 1):
        digest = hashlib.sha256()
        for i, (_, _, _, role, text) in enumerate(rows):
            digest.update(("\n" * (i > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        out.append((conv, digest.hexdigest()))
        if len(out) >= 10_000:
            yield out
            out = []
    if out:
        yield out


def streamed(df: DataFrame, step, schema: str) -> DataFrame:
    """``step`` over the sorted rows of each partition, list of tuples by list of tuples, without holding a group."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for rows in step(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)

    return df.mapInArrow(run, schema)


def normalised(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, chunk, turn, role, text, digest) with nulls in role and text as one space."""
    rows = renamed(rows, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    space = F.lit(" ")
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    chunk = F.coalesce(F.greatest(F.lit(0).cast("long"), F.floor(F.col("turn") / CHUNK)), F.lit(0).cast("long"))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    return rows.withColumns({"chunk": chunk, "digest": digest})


#: The order of rows; ascending order puts nulls first.
ORDER = ["conv_id", "chunk", "turn", "role", "digest"]


def with_faults(rows: DataFrame) -> DataFrame:
    """(conv_id, chunk, turn, role, digest, nth, fault): no texts."""
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    light = rows.select("conv_id", "chunk", "turn", "role", "digest", last.alias("last"))
    light = light.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy("turn")))
    fault = F.when(F.col("last") == "", BLANK).when(F.col("nth") > 1, DUPLICATE).when(~F.col("last").isin(".", "!", "?"), TRUNCATED).otherwise(0)
    return light.withColumn("fault", fault)


def audited(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, pieces): a row for each conversation, written; ``pieces`` are the letters of each chunk."""
    rows = normalised(conversations, conv_col, turn_col, role_col, text_col)
    kind = rows.schema["conv_id"].dataType.simpleString()
    light = with_faults(rows).repartition("conv_id", "chunk").sortWithinPartitions(*ORDER, "nth").select("conv_id", "chunk", "turn", F.substring("role", 1, 1).alias("initial"), "fault")
    counts = ", ".join(f"{c} long" for c in COUNTS)
    chunks = streamed(light, chunk_paths, f"conv_id {kind}, chunk long, first string, last string, low long, high long, {counts}, paths {PATHS}")
    schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, pieces array<struct<chunk: long, state: int, letters: string>>"
    return written(streamed(chunks.repartition("conv_id").sortWithinPartitions("conv_id", "chunk"), chunk_joins, schema), "audits")


def repaired(conversations: DataFrame, audits: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, chunk, position, edit, role, text): the rows after the edits of ``audits``; (chunk, position) is their order."""
    rows = normalised(conversations, conv_col, turn_col, role_col, text_col)
    kind = rows.schema["conv_id"].dataType.simpleString()
    plan = audits.select("conv_id", F.explode("pieces").alias("p")).select("conv_id", "p.chunk", F.col("p.state").alias("state"), F.col("p.letters").alias("text"))
    both = rows.withColumn("state", F.lit(None).cast("int")).unionByName(plan, allowMissingColumns=True)
    both = both.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", F.col("state").asc_nulls_last(), "turn", "role", "digest")
    return streamed(both.select("conv_id", "chunk", "turn", "state", "role", "text"), edited, f"conv_id {kind}, chunk long, position long, edit string, role string, text string")


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) over ``role:text`` of the repaired rows, joined by newlines."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "position")
    return streamed(ordered.select("conv_id", "chunk", "position", "role", "text"), hashed, f"conv_id {kind}, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """The contract's damage, by crc32 of ``conv_id:turn`` modulo 20: rows dropped, emptied, without ends of sentences, repeated or given to the user."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = renamed(conversations, conv_id="conv_id", turn="turn", role="role", text="text").withColumn("kind", kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(text_of("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")

