"""Column expressions: keys, orderings, name rules and rule lists. Pure functions of columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Three-letter to one-letter residue codes.
AMINO_ACIDS = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}
#: Van der Waals radii by method; the default is under the empty element.
RADII = {
    "vdw": {
        "H": 1.20, "C": 1.70, "N": 1.55, "O": 1.52, "F": 1.47, "P": 1.80, "S": 1.80, "CL": 1.75, "BR": 1.85, "I": 1.98,
        "MG": 1.73, "MN": 1.79, "FE": 1.72, "CO": 1.67, "NI": 1.63, "CU": 1.40, "ZN": 1.39, "CA": 2.31, "NA": 2.27, "K": 2.75, "": 1.70,
    },
    "standard": {"H": 1.20, "C": 1.70, "N": 1.55, "O": 1.52, "F": 1.47, "P": 1.80, "S": 1.80, "I": 1.98, "": 1.50},
}
#: Spellings of the eight interaction types.
INTERACTIONS = {
    "hydrogen_bonds": ("hydrogen_bond", "hydrogen_bonds", "hbond"),
    "hydrophobic_interactions": ("hydrophobic_interaction", "hydrophobic_interactions", "hydrophobic"),
    "salt_bridges": ("salt_bridge", "salt_bridges", "ionic"),
    "pi_stacks": ("pi_stack", "pi_stacks", "pi_stacking"),
    "pi_cation_interactions": ("pi_cation_interaction", "pi_cation_interactions"),
    "halogen_bonds": ("halogen_bond", "halogen_bonds"),
    "metal_complexes": ("metal_complex", "metal_complexes", "metal"),
    "water_bridges": ("water_bridge", "water_bridges"),
}
#: Supertypes of interaction types; those of water bridges and halogen bonds are our choice.
SUPERTYPES = {
    "hydrogen_bonds": "Polar contact", "salt_bridges": "Polar contact", "water_bridges": "Polar contact", "halogen_bonds": "Polar contact",
    "hydrophobic_interactions": "Hydrophobic contact", "pi_stacks": "Pi interaction", "pi_cation_interactions": "Pi interaction", "metal_complexes": "Metal coordination",
}


def literal_map(m: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in m.items() for x in kv])


def residue_key(resname: Column, resseq: Column, chain: Column, icode: Column) -> Column:
    """RESNAME+RESSEQ+CHAIN+ICODE; blanks vanish."""
    return F.concat_ws("", F.upper(F.trim(resname)), resseq.cast("string"), F.trim(chain), F.trim(icode))


def residue_base(label: Column) -> Column:
    """Chain-insensitive RESNAME+RESSEQ of a label; null where there is none. The insertion code of structured labels is kept by ``residue_base_of``."""
    found = F.regexp_extract(F.upper(F.trim(label)), r"^([A-Z]{1,3}|[0-9][A-Z]{2})(-?[0-9]+)", 0)
    return F.when(found != "", found)


def residue_base_of(resname: Column, resseq: Column, icode: Column) -> Column:
    return F.concat_ws("", F.upper(F.trim(resname)), resseq.cast("string"), F.trim(icode))


def residue_display(base: Column) -> Column:
    """ASN317 -> N317; names without a letter stay."""
    name, rest = F.regexp_extract(base, r"^([A-Z]+)", 1), F.regexp_extract(base, r"(-?[0-9].*)$", 1)
    return F.concat(F.coalesce(F.element_at(literal_map(AMINO_ACIDS), name), name), rest)


def one_letter(resname: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(AMINO_ACIDS), F.upper(F.trim(resname))), F.lit("X"))


def natural_key(text: Column, width: int = 12) -> Column:
    """Sorts digit runs by value: lower case, each run padded to ``width`` digits."""
    padded = F.regexp_replace(F.lower(text), r"([0-9]+)", "0" * width + "$1")
    return F.regexp_replace(padded, rf"0*([0-9]{{{width}}})(?![0-9])", "$1")


def last_integer(text: Column, missing: int = 10**12) -> Column:
    run = F.regexp_extract(text, r"([0-9]+)[^0-9]*$", 1)
    return F.coalesce(F.when(run != "", run).try_cast("long"), F.lit(missing).cast("long"))


def shift_last_integer(text: Column, by: int) -> Column:
    """The last digit run plus ``by``, at least as wide as before."""
    head, run, tail = (F.regexp_extract(text, r"^(.*?)([0-9]+)([^0-9]*)$", i) for i in (1, 2, 3))
    moved = (run.cast("long") + by).cast("string")
    return F.when(run == "", text).otherwise(F.concat(head, F.lpad(moved, F.greatest(F.length(run), F.length(moved)), "0"), tail))


def class_name(number: Column, prefix: str = "class", separator: str = "_", width: int = 0) -> Column:
    text = number.cast("string")
    return F.concat(F.lit(prefix + separator), F.lpad(text, F.greatest(F.length(text), F.lit(width)), "0") if width else text)


def graph_token(text: Column) -> Column:
    """White space becomes ``_``, other characters outside ``[A-Za-z0-9_.:-]`` too; nothing becomes ``_``."""
    blank = r"[ \t\n\r\f\x0B]+"
    bare = F.regexp_replace(text, f"^{blank}|{blank}$", "")
    clean = F.regexp_replace(F.regexp_replace(bare, blank, "_"), r"[^A-Za-z0-9_.:-]", "_")
    return F.when(clean == "", "_").otherwise(clean)


def ligand_node_key(mode: str, resname: Column, chain: Column, resseq: Column, icode: Column, atom: Column, serial: Column) -> Column:
    """``atom_name``, ``serial_atom_name``, ``residue_atom_name_serial``, or else the residue and the atom."""
    tail = F.concat(F.lit("@serial:"), serial.cast("string"))
    full = F.concat_ws(":", resname, F.when(F.trim(chain) == "", "_").otherwise(chain), F.concat(resseq.cast("string"), F.trim(icode)), atom)
    return {"atom_name": atom, "legacy_atom_name": atom, "serial_atom_name": F.concat(atom, tail), "residue_atom_name_serial": F.concat(full, tail)}.get(mode.lower(), full)


def ligand_label(mode: str, resname: Column, chain: Column, resseq: Column, icode: Column, atom: Column, element: Column, repeated: Column | None = None) -> Column:
    """The label that classification compares; an unknown mode, ``auto`` too, falls back to the bare atom name."""
    mode = mode.lower()
    own = F.concat_ws("_", graph_token(resname), F.concat(graph_token(chain), graph_token(resseq.cast("string")), F.trim(icode)), graph_token(atom))
    if mode == "node_key":
        return graph_token(ligand_node_key("residue_atom_name", resname, chain, resseq, icode, atom, F.lit("")))
    if mode in ("residue_atom_name", "unique_residue_atom_name"):
        return own
    if mode in ("atom_name_with_residue_for_duplicates", "duplicate_aware_atom_name") and repeated is not None:
        return F.when(repeated, own).otherwise(graph_token(atom))
    if mode == "element":
        return graph_token(F.when(F.trim(element) != "", element).otherwise(atom))
    return graph_token(atom)


def vdw_radius(element: Column, method: str = "vdw") -> Column:
    table = RADII[method]
    return F.coalesce(F.element_at(literal_map({k: v for k, v in table.items() if k}), F.upper(F.trim(element))), F.lit(table[""]))


def is_hydrogen(element: Column, atom_name: Column) -> Column:
    return (F.upper(F.trim(element)) == "H") | F.upper(F.trim(atom_name)).startswith("H")


def interaction_type(raw: Column) -> Column:
    """A spelling of one of the eight interaction types to its name; others stay, in lower case."""
    t = F.replace(F.lower(F.trim(raw)), F.lit("-"), F.lit("_"))
    return F.coalesce(F.element_at(literal_map({x: k for k, v in INTERACTIONS.items() for x in v}), t), t)


def supertype(kind: Column, overrides: dict[str, str] | None = None) -> Column:
    return F.coalesce(F.element_at(literal_map(SUPERTYPES | (overrides or {})), kind), F.lit("Other"))


def selection_status(checks: Sequence[tuple[Column, str]], passed: str = "selected") -> Column:
    """Reasons whose check fails or is null, joined by ``; ``; ``passed`` if there is none."""
    text = F.concat_ws("; ", *[F.when(~F.coalesce(ok, F.lit(False)), why) for ok, why in checks])
    return F.when(text == "", passed).otherwise(text)


def first_rule(rules: Iterable[tuple[str, Column, Column]], default: Column) -> tuple[Column, Column]:
    """(decision, id of the rule that decided) of the first rule whose predicate holds."""
    rules = list(rules)
    if not rules:
        return default, F.lit(None).cast("string")
    return (
        F.coalesce(*[F.when(when, decision) for _, when, decision in rules], default),
        F.coalesce(*[F.when(when, F.lit(name)) for name, when, _ in rules]),
    )


def selector(spec: dict, columns: dict[str, str] | None = None) -> Column:
    """Config selector -> predicate. Keys: record, resname, chain (``*``: any), resseq, icode, atom; values or lists of them."""
    out = F.lit(True)
    for key, wanted in spec.items():
        if wanted in (None, "*", ["*"]):
            continue
        wanted = list(wanted) if isinstance(wanted, list | tuple | set) else [wanted]
        c = F.col((columns or {}).get(key, key))
        out = out & (c.isin([int(w) for w in wanted]) if key == "resseq" else F.upper(F.trim(c)).isin([str(w).strip().upper() for w in wanted]))
    return out


def residue_ranges(text: str) -> list[tuple[int, int]]:
    """``1-120,290-300`` -> inclusive pairs; reversed or empty ranges raise."""
    out = []
    for part in text.split(","):
        lo, _, hi = part.strip().partition("-") if not part.strip().startswith("-") else (part.strip(), "", "")
        try:
            a, b = int(lo), int(hi or lo)
        except ValueError:
            raise ValueError(f"not a residue range: {part!r}") from None
        if b < a:
            raise ValueError(f"reversed residue range: {part!r}")
        out.append((a, b))
    return out


def in_ranges(resseq: Column, ranges: Iterable[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for lo, hi in ranges:
        out = out | resseq.between(lo, hi)
    return out


def parse_bool(text: Column) -> Column:
    t = F.lower(F.trim(text.cast("string")))
    return F.when(t.isin("true", "1", "1.0", "yes", "y", "t"), True).when(t.isin("false", "0", "0.0", "no", "n", "f"), False)


def token_number(token: Column) -> Column:
    """The token where it is all digits."""
    return F.when(token.rlike("^[0-9]+$"), token)


def first_number(tokens: Column, *words: str, before: str | None = None, whole: bool = True) -> Column:
    """The first number among ``tokens`` that follows one of ``words``, as the next token or joined to the word; or that stands ``before`` a word (or, if not
    ``whole``, before a token that begins so); or, with neither, any number. Null if there is none."""

    def here(token: Column, i: Column) -> Column:
        after = F.coalesce(F.get(tokens, i + 1), F.lit(""))
        if before is not None:
            return F.when((after == before) if whole else after.startswith(before), token_number(token))
        if not words:
            return token_number(token)
        return F.coalesce(*[F.when(token == w, token_number(after)) for w in words], *[F.when(token.startswith(w), token_number(F.substring(token, len(w) + 1, 1000))) for w in words])

    return F.get(F.filter(F.transform(tokens, here), lambda x: x.isNotNull()), F.lit(0))
