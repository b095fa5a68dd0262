"""A selection language over an `atoms` table, parsed to column expressions.

atoms: idx (structure), atom, name, resn, resi, chain, icode, elem, x, y, z and, where used, alt, b_factor, charge,
fragment, ss (helix, sheet, turn, loop), polar.  Words are case-insensitive; operators by precedence: NOT, AND, XOR, OR.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: residue and element classes
AMINO = "ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL MSE SEC".split()
WATER = "HOH WAT DOD TIP3".split()
SOLVENT = "SO4 PO4 GOL EDO DMS ACT PEG FMT".split()
CAPS = "ACE NME NH2".split()
BACKBONE = "N CA C O OXT".split()
METALS = "LI NA K MG CA MN FE CO NI CU ZN CD HG".split()
_TOKEN = re.compile(r"\s*(?:(\()|(\))|([A-Za-z_][A-Za-z0-9_*']*)|([-+]?\d+(?:\.\d+)?(?:-\d+)?)|('[^']*'|\"[^\"]*\")|([<>=!]=?|[,+:*]))")
FIELDS = {"NAME": "name", "RESN": "resn", "CHAIN": "chain", "ELEM": "elem", "ALT": "alt", "RESI": "resi", "INDEX": "atom", "ID": "atom", "B_FACTOR": "b_factor", "FRAGMENT": "fragment"}
NUMBERS = {"RESI", "INDEX", "ID", "B_FACTOR", "FRAGMENT"}
DISTANCES = ("AROUND", "EXPAND", "BEYOND")
GROUPS = {"BY_RES": ["idx", "chain", "resi", "icode"], "BY_CHAIN": ["idx", "chain"]}


def _flags() -> dict[str, Column]:
    name, resn, elem = F.upper("name"), F.upper("resn"), F.upper("elem")
    protein, water, solvent = resn.isin(AMINO), resn.isin(WATER), resn.isin(SOLVENT)
    metal, cap, hydrogen = elem.isin(METALS), resn.isin(CAPS), elem.isin("H", "D")
    return {
        "TRUE": F.lit(True),
        "ALL": F.lit(True),
        "FALSE": F.lit(False),
        "NONE": F.lit(False),
        "PROTEIN": protein,
        "WATER": water,
        "SOLVENT": solvent | water,
        "METAL": metal,
        "CAPPING": cap,
        "ORGANIC": ~(protein | water | metal | cap) & elem.isNotNull(),
        "LIGAND": ~(protein | water | solvent | metal | cap) & elem.isNotNull(),
        "BACKBONE": protein & name.isin(BACKBONE),
        "HYDROGEN": hydrogen,
        "HEAVY": ~hydrogen,
    }


@dataclass(frozen=True)
class Node:
    word: str
    parts: tuple[Node, ...] = ()
    values: tuple = ()

    def canonical(self) -> str:
        if self.word == "NOT":
            return f"not ({self.parts[0].canonical()})"
        if self.word in ("AND", "OR", "XOR"):
            return f"({self.parts[0].canonical()} {self.word.lower()} {self.parts[1].canonical()})"
        if self.word in DISTANCES:
            return f"{self.word.lower()} {self.values[0]:g} of ({self.parts[0].canonical()})"
        if self.word in GROUPS:
            return f"{self.word.lower()} ({self.parts[0].canonical()})"
        return " ".join([self.word.lower(), "+".join(str(v if not isinstance(v, tuple) else f"{v[0]}-{v[1]}") for v in self.values)]).strip()

    def contains(self, word: str) -> bool:
        return self.word == word.upper() or any(p.contains(word) for p in self.parts)


def parse(text: str) -> Node:
    """The tree of a selection; ValueError where it isn't one.  An empty selection selects everything."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"can't read {text[at:]!r}")
        tokens.append(m.group().strip())
        at = m.end()
    if not tokens:
        return Node("TRUE")
    place = 0

    def peek() -> str:
        return tokens[place].upper() if place < len(tokens) else ""

    def take() -> str:
        nonlocal place
        if place >= len(tokens):
            raise ValueError("the selection ends too early")
        place += 1
        return tokens[place - 1]

    def chain(word: str, inner: Callable[[], Node]) -> Callable[[], Node]:
        def level() -> Node:
            left = inner()
            while peek() == word:
                take()
                left = Node(word, (left, inner()))
            return left

        return level

    def unary() -> Node:
        word = take().upper()
        if word == "NOT":
            return Node("NOT", (unary(),))
        if word == "(":
            inside = whole()
            if take() != ")":
                raise ValueError("a parenthesis isn't closed")
            return inside
        if word in GROUPS:
            return Node(word, (unary(),))
        if word in DISTANCES:
            try:
                far = float(take())
            except ValueError:
                raise ValueError(f"{word} needs a distance") from None
            if peek() == "OF":
                take()
            return Node(word, (unary(),), (far,))
        if word in FIELDS:
            values = [value(word)]
            while peek() in ("+", ","):
                take()
                values.append(value(word))
            return Node(word, (), tuple(values))
        if word in _FLAG_NAMES:
            return Node(word)
        raise ValueError(f"unknown word {word!r}")

    def value(word: str):
        v = take()
        if word in NUMBERS:
            if v in (">", "<", ">=", "<=", "=", "=="):
                return (v, float(take()))
            if m := re.fullmatch(r"(-?\d+)-(\d+)", v):
                return (int(m[1]), int(m[2]))
            try:
                return float(v) if "." in v else int(v)
            except ValueError:
                raise ValueError(f"{word} needs a number, not {v!r}") from None
        return v.strip("'\"")

    whole = chain("OR", chain("XOR", chain("AND", unary)))
    tree = whole()
    if place < len(tokens):
        raise ValueError(f"unexpected {tokens[place]!r}")
    return tree


_FLAG_NAMES = frozenset("TRUE ALL FALSE NONE PROTEIN WATER SOLVENT METAL CAPPING ORGANIC LIGAND BACKBONE HYDROGEN HEAVY HELIX SHEET TURN LOOP SECONDARY_STRUCTURE POLAR_HYDROGEN NONPOLAR_HYDROGEN".split())


def _field(node: Node) -> Column:
    column = F.col(FIELDS[node.word])
    tests = []
    for v in node.values:
        if isinstance(v, tuple) and isinstance(v[0], str):
            tests.append({">": column > v[1], "<": column < v[1], ">=": column >= v[1], "<=": column <= v[1]}.get(v[0], column == v[1]))
        elif isinstance(v, tuple):
            tests.append(column.between(*v))
        elif node.word in NUMBERS:
            tests.append(column == v)
        else:
            pattern = re.escape(v.upper()).replace(r"\*", ".*")
            tests.append(F.upper(column).rlike(f"^{pattern}$"))
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return F.coalesce(out, F.lit(False))


def mark(atoms: DataFrame, selection: str | Node) -> DataFrame:
    """atoms with the boolean `selected`."""
    tree = parse(selection) if isinstance(selection, str) else selection
    count = 0

    def column(node: Node) -> Column:
        nonlocal atoms, count
        if node.word == "NOT":
            return ~column(node.parts[0])
        if node.word in ("AND", "OR", "XOR"):
            a, b = column(node.parts[0]), column(node.parts[1])
            return a & b if node.word == "AND" else a | b if node.word == "OR" else a != b
        if node.word in FIELDS:
            return _field(node)
        if node.word in ("HELIX", "SHEET", "TURN", "LOOP"):
            return F.coalesce(F.lower("ss") == node.word.lower(), F.lit(False))
        if node.word == "SECONDARY_STRUCTURE":
            return F.coalesce(F.lower("ss").isin("helix", "sheet", "turn"), F.lit(False))
        if node.word in ("POLAR_HYDROGEN", "NONPOLAR_HYDROGEN"):
            return _flags()["HYDROGEN"] & F.coalesce(F.col("polar") == (node.word == "POLAR_HYDROGEN"), F.lit(False))
        if node.word not in GROUPS and node.word not in DISTANCES:
            return F.coalesce(_flags()[node.word], F.lit(False))
        inside = column(node.parts[0])
        count += 1
        name = f"_s{count}"
        atoms = atoms.withColumn(name, inside)
        if node.word in GROUPS:
            atoms = atoms.withColumn(name, F.max(name).over(Window.partitionBy(*GROUPS[node.word])))
            return F.col(name)
        atoms = _near(atoms, name, node.values[0])
        close, own = F.col(f"{name}_near"), F.col(name)
        return close & ~own if node.word == "AROUND" else close | own if node.word == "EXPAND" else ~close & ~own

    selected = column(tree)
    out = atoms.withColumn("selected", selected)
    return out.drop(*[c for c in out.columns if re.match(r"_s\d+", c)])


def _near(atoms: DataFrame, name: str, far: float) -> DataFrame:
    """`<name>_near`: within `far` of an atom with `name`, by an equi-join on grid cells of that width."""
    width = max(far, 1e-6)
    cell = [F.floor(F.col(c) / width).cast("bigint") for c in ("x", "y", "z")]
    seeds = atoms.where(name).select(F.col("idx").alias("_i"), *[F.col(c).alias(f"_{c}") for c in "xyz"], *[k.alias(f"_c{n}") for n, k in enumerate(cell)])
    for n in range(3):
        seeds = seeds.withColumn(f"_c{n}", F.explode(F.array(*[F.col(f"_c{n}") + s for s in (-1, 0, 1)])))
    placed = atoms.select("idx", "atom", "x", "y", "z", *[k.alias(f"c{n}") for n, k in enumerate(cell)])
    on = (F.col("idx") == F.col("_i")) & (F.col("c0") == F.col("_c0")) & (F.col("c1") == F.col("_c1")) & (F.col("c2") == F.col("_c2"))
    gap = sum(((F.col(c) - F.col(f"_{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    hits = placed.join(seeds, on).where(gap <= far * far).select("idx", "atom").distinct().withColumn(f"{name}_near", F.lit(True))
    return atoms.join(hits, ["idx", "atom"], "left").withColumn(f"{name}_near", F.coalesce(f"{name}_near", F.lit(False)))


def select(atoms: DataFrame, selection: str) -> DataFrame:
    return mark(atoms, selection).where("selected").drop("selected")


def count(atoms: DataFrame, selection: str) -> int:
    return select(atoms, selection).count()


def selectors(atoms: DataFrame) -> DataFrame:
    """Distinct residue selectors NAME:NUMBER:ICODE:CHAIN."""
    return atoms.select(F.concat_ws(":", F.coalesce("resn", F.lit("")), F.col("resi").cast("string"), F.coalesce("icode", F.lit(" ")), F.coalesce("chain", F.lit(" "))).alias("selector")).distinct()


def is_empty(selection: str) -> bool:
    """Whether a selection says nothing, and so selects every atom."""
    return not selection.strip()


def structure_selectors(atoms: DataFrame) -> DataFrame:
    """(idx, selectors): the distinct residue selectors of each structure, sorted."""
    one = F.concat_ws(":", F.coalesce("resn", F.lit("")), F.col("resi").cast("string"), F.coalesce("icode", F.lit(" ")), F.coalesce("chain", F.lit(" ")))
    return atoms.groupBy("idx").agg(F.sort_array(F.collect_set(one)).alias("selectors"))


def selector_set(text: str) -> set[str]:
    """Selectors of a comma-, semicolon- or space-separated list."""
    return {s for s in re.split(r"[,;\s]+", text.strip()) if s}
