"""Personal data by fixed shapes and bootstrapped contexts, in DataFrame functions only.

Base spans: matches of the four shapes below, leftmost and non-overlapping per kind, of which those
that fail their test are dropped. Positions come from marking the matches in the text and summing
piece lengths, in code points.

Bootstrapping: the seeds are the base values and secrets, long runs of letters and digits with both. Every seed and every
candidate (another token with a digit or an at sign, or in quotes, less the signs around it) is an occurrence of a value in
lexical patterns of four lengths: the two words to its left, the one to its left, the one to its right, and the ones on both
sides. In them words with a digit or an at sign are one placeholder, so that lists and tables have patterns too; where the
text begins or ends sooner, the pattern says so. Over the pattern-value graph, each round scores patterns by the share and the logarithm of their known values
(RlogF), accepts confident ones (patterns of a single word need more), scores the unknown values by their accepted patterns and
adds confident values to the known, until a round adds none. Secrets and occurrences of discovered values, under the kind of
the seeds that led to them, become further spans; base spans always stay.

Nulls are empty texts; equal matches are spans of their own; rows with equal id and text share their
spans; null ids are carried along; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, renamed, written

KINDS = ("email", "ip", "card", "phone", "secret")
#: Base spans are of these; secrets are seeds besides.
N_BASE = 4
#: The shapes, written so that no input makes them backtrack more than linearly: possessive loops, and starts only where a leftmost match can start.
SHAPES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])[A-Za-z0-9]{32,}+",
}
HINTS = {"email": "@", "phone": "+"}
OTHER = r"(?<!\S)(?:[^\s0-9@]*+[0-9@]\S*+|[\"'][^\s\"']{3,}+[\"']\S*+)"
#: Signs around a candidate that are not of it.
LEADING, TRAILING, CLOSING = r"^[\"'(\[{<]++", r"(?<![\"')\]}>.,;:!?])[\"')\]}>.,;:!?]++$", r"^[\"')\]}>.,;:!?]++"
#: Marks of our own, in no text: around matches and as the placeholder of identifiers, and as the word before the first.
EDGE, INSTEAD, BEGINNING, ENDING = "\uE000", "\uE001", "\uE002", "\uE003"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
#: Known values and their share that accept a pattern of several words, and one of a single word; what accepts a value.
MIN_SUPPORT, MIN_PRECISION, MIN_VALUE_SCORE = (3, 5), (0.5, 0.8), 1.0


def pieces(text: Column, shape: str) -> Column:
    """The text cut before and after each match: gaps at even places, matches at odd ones."""
    return F.split(F.regexp_replace(text, shape, f"{EDGE}$0{EDGE}"), EDGE, -1)


def context(left: Column) -> Column:
    """The last two words of ``left``, in lower case and with identifiers as EDGE.

    Cut from the reversed text by an anchored pattern without backtracking, so that no length needs a limit. A word that
    runs on into the match stays open: words are only ever added to the right.
    """
    bare = F.regexp_replace(F.reverse(left), LEADING, "")  # signs that open here belong to neither
    words = F.reverse(F.regexp_extract(bare, r"^\s*+(?:\S++(?:\s++\S++)?+)?+", 0))
    words = F.regexp_replace(F.lower(words), r"\s+", " ")
    return F.regexp_replace(words, rf"(?<!\S)[^\s0-9@{EDGE}]*+[0-9@{EDGE}]\S*+", EDGE)


def following(gap: Column) -> Column:
    """The first word after a match, in lower case and with identifiers as EDGE; ENDING where there is none, EDGE where the next match comes first."""
    word = F.lower(F.regexp_extract(F.regexp_replace(gap, CLOSING, ""), r"^\s*+(\S++)", 1))
    return F.when(gap.isNull(), ENDING).when(word == "", EDGE).otherwise(F.when(word.rlike(f"[0-9@{EDGE}]"), EDGE).otherwise(word))


SPAN = "struct<start: int, end: int, value: string, before: string, after: string>"


def located(cut: Column) -> Column:
    """(start, end, value, before, after) of each match: ``before`` are the two words to its left in the whole text, ``after`` the one to its right."""
    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("match"), F.lit(f"{BEGINNING} ").alias("left"), F.array().cast(f"array<{SPAN}>").alias("out"))
    last = F.size(cut) - 1

    def step(acc, x):
        piece = x["piece"]
        end = acc["at"] + F.length(piece)
        span = F.struct(acc["at"].alias("start"), end.alias("end"), piece.alias("value"), acc["left"].alias("before"), x["after"].alias("after"))
        return F.struct(
            end.alias("at"), (~acc["match"]).alias("match"), F.when(acc["match"], F.concat(acc["left"], F.lit(EDGE))).otherwise(context(F.concat(acc["left"], piece))).alias("left"),
            F.when(acc["match"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"),
        )

    def beside(piece, i):
        gap = F.get(cut, i + 1)
        empty = (i + 1 == last) & (F.trim(gap) == "")  # nothing but the text's end
        return F.struct(piece.alias("piece"), F.when(i % 2 == 1, F.when(empty, ENDING).otherwise(following(gap))).alias("after"))

    none = F.array().cast(f"array<{SPAN}>")
    return F.when(F.size(cut) > 1, F.aggregate(F.transform(cut, beside), zero, step, lambda acc: acc["out"])).otherwise(none)


def trimmed(span: Column) -> Column:
    """A candidate without the signs around it."""
    head = F.regexp_replace(span["value"], LEADING, "")
    value = F.regexp_replace(head, TRAILING, "")
    start = span["start"] + F.length(span["value"]) - F.length(head)
    return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), span["before"].alias("before"), span["after"].alias("after"))


def patterns(before: Column, after: Column) -> Column:
    """(pattern, words): the lexical patterns of an occurrence and how many words each has."""
    left, right = F.regexp_extract(before, r"(\S*\s*)$", 1), after
    text = lambda name, *parts: F.concat_ws("|", F.lit(name), *parts)
    each = [(text("ll", before), 2), (text("l", left), 1), (text("r", right), 1), (text("lr", left, right), 2)]
    return F.array(*[F.struct(p.alias("pattern"), F.lit(n).alias("words")) for p, n in each])


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "secret":
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return F.lit(True)


def of_kind(i: int, kind: str) -> Column:
    good = F.filter(located(F.col(f"c_{kind}")), lambda s: valid(kind, s["value"]))
    fields = ("start", "end", "value", "before", "after")
    return F.transform(good, lambda s: F.struct(F.lit(i).alias("kind"), *[s[f].alias(f) for f in fields]))


def shaped(docs: DataFrame) -> DataFrame:
    """(id, tk, base, other): spans of seeds (base and secrets) with their kinds and the other candidate tokens of every text."""
    # marks of our own must not be in the text; all of them count one and belong to no shape
    text = F.translate(F.coalesce("text", F.lit("")), EDGE + BEGINNING + ENDING, INSTEAD * 3)
    d = docs.select("id", F.xxhash64("text").alias("tk"), text.alias("t"))
    kinds = {}
    for kind in KINDS:
        cut = pieces(F.col("t"), SHAPES[kind])
        if kind in HINTS:
            cut = F.when(F.contains("t", F.lit(HINTS[kind])), cut)
        kinds[f"c_{kind}"] = cut
    kinds["c_other"] = pieces(F.col("t"), OTHER)
    d = d.withColumns(kinds).drop("t")
    spans = []
    for i, kind in enumerate(KINDS):
        spans.append(of_kind(i, kind))
    d = d.select("id", "tk", F.concat(*spans).alias("base"), located(F.col("c_other")).alias("other"))
    free = F.filter("other", lambda o: ~F.exists("base", lambda b: (b["start"] < o["end"]) & (o["start"] < b["end"])))
    return d.select("id", "tk", "base", F.filter(F.transform(free, trimmed), lambda o: o["value"] != "").alias("other"))


def discovered_values(found: DataFrame) -> DataFrame:
    """(value, kind): values of candidates that were accepted as ``kind``."""
    spans = lambda c, kind: found.select(F.explode(c).alias("s")).select(F.explode(patterns(F.col("s.before"), F.col("s.after"))).alias("p"), F.col("s.value").alias("value"), kind.alias("kind"))
    rows = spans("base", F.col("s.kind")).union(spans("other", F.lit(None).cast("int"))).select("p.pattern", "p.words", "value", "kind")
    edges = written(rows.groupBy("pattern", "words", "value").agg(F.min("kind").alias("seed")), "edges")
    known = written(edges.where("seed is not null").groupBy("value").agg(F.min("seed").alias("kind")), "known")
    several = F.col("words") > 1
    enough = lambda x, two: x >= F.when(several, two[0]).otherwise(two[1])
    while True:  # every round adds values of a finite table, or is the last
        marked = edges.join(known, "value", "left")
        total = marked.groupBy("pattern").agg(F.count("*").alias("values"))
        hits = marked.where("kind is not null").groupBy("pattern", "words", "kind").agg(F.count("*").alias("hits"))
        scored = hits.join(total, "pattern").withColumn("precision", F.col("hits") / F.col("values"))
        good = scored.where(enough(F.col("hits"), MIN_SUPPORT) & enough(F.col("precision"), MIN_PRECISION))
        good = good.select("pattern", F.col("kind").alias("as"), (F.col("precision") * F.log2(F.col("hits") + F.lit(1))).alias("score"))
        votes = marked.where("kind is null").join(good, "pattern").groupBy("value", "as").agg(F.max("score").alias("score"))  # its best pattern; they overlap
        best = votes.groupBy("value").agg(F.max(F.struct("score", (-F.col("as")).alias("as"))).alias("b"))
        new = best.where(F.col("b.score") >= MIN_VALUE_SCORE).select("value", (-F.col("b.as")).alias("kind"))
        new = written(new, "new")
        if new.isEmpty():
            break
        known = written(known.union(new), "known")
    return edges.where("seed is null").select("value").distinct().join(known, "value")


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tk, base, added): arrays of (kind, start, end) of every row; kind is the place in KINDS. Secrets are among ``added``."""
    d = renamed(docs, id=id_col, text=text_col)
    found = written(shaped(d), "shaped")
    values = discovered_values(found)
    extra = found.where(F.size("other") > 0).select("id", "tk", F.explode("other").alias("s")).join(values, F.col("s.value") == F.col("value"))
    extra = extra.groupBy("id", "tk").agg(F.collect_set(F.struct("kind", "s.start", "s.end")).alias("added"))
    slim = lambda c: F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    of = lambda base: slim(F.filter("base", lambda s: (s["kind"] < N_BASE) == base))
    f = found.select("id", "tk", of(F.lit(True)).alias("base"), of(F.lit(False)).alias("secrets"))
    joined = f.join(extra.withColumnsRenamed({"id": "xi", "tk": "xt"}), f.id.eqNullSafe(F.col("xi")) & f.tk.eqNullSafe(F.col("xt")), "left")
    none = F.array().cast("array<struct<kind: int, start: int, end: int>>")
    return joined.select(F.col("id").alias("doc_id"), "tk", "base", F.concat("secrets", F.coalesce("added", none)).alias("added"))


def masked(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; where spans overlap, the first stands."""
    own_id, own_key, own_spans = (free_name(c, *docs.columns) for c in ("__id", "__tk", "__spans"))
    s = spans.where("size(base) + size(added) > 0").select(F.col("doc_id").alias(own_id), F.col("tk").alias(own_key), F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))).alias(own_spans))
    s = s.dropDuplicates([own_id, own_key])
    j = docs.join(s, docs[f"`{id_col}`"].eqNullSafe(F.col(own_id)) & F.xxhash64(docs[f"`{text_col}`"]).eqNullSafe(F.col(own_key)), "left")
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    text = F.col(f"`{text_col}`")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        part = F.concat(text.substr(acc["at"] + 1, x["start"] - acc["at"]), F.element_at(names, x["kind"] + 1))
        return F.when(x["start"] < acc["at"], acc).otherwise(F.struct(x["end"].alias("at"), F.concat(acc["out"], F.array(part)).alias("out")))

    whole = F.aggregate(own_spans, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), text.substr(acc["at"] + 1, F.length(text))))
    return j.withColumn(text_col, F.when(F.col(own_spans).isNull(), text).otherwise(whole)).select(*[F.col(f"`{c}`") for c in docs.columns])
