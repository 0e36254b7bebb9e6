"""Personal data: exact base patterns, and candidates selected by gradient-boosted trees.

The base spans (email, ip, card, phone) follow the contract's patterns, leftmost and without
overlap within a kind, checked but not retried. Beside them, wide generators propose
candidates of each kind that may overlap anything: unusual mail names, addresses spelled with
"at" and "dot", card groups inside longer runs of digits, phone numbers without a plus sign. Boosted
trees read a candidate's format (digits, separators, groups, Luhn) and context (neighbouring
characters, words before it). A candidate that meets a base span of its kind is an example for
it, any other one against it; what sets the base patterns apart (the plus sign, the ending of a
mail name) is no feature, so that a candidate that only lacks that is judged like them. A kind's threshold is the lowest score that keeps the
precision at ``PRECISION`` on the fifth of the documents that the trees have not seen; selected
candidates that meet no base span of any kind are added (those of two kinds may overlap).

Everything is DataFrame expressions. Positions come from the gaps between the matches, so a text
is never exploded. Only counts of feature tuples (each feature has a few values; below
10,000 tuples in practice) reach the driver, where the trees are grown; the trees return as
CASE expressions. Patterns are possessive: the time is linear even in a text that is one long word.

Nulls: a null text counts as empty and has no spans. Every row keeps its own result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelspark.llm.common import fold

KINDS = ("email", "ip", "card", "phone")
# The base patterns of the contract, written so that no start is tried twice. A
# mail name starts where the name's characters start, or where the last match ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"[^\s@<>()\[\],;]++@[^\s@<>()\[\],;]++|(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?[(\[]dot[)\]]\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:[\x20.,]{1,2}+[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20.-]?[0-9]{4}){3}(?![0-9A-Za-z])|(?<![0-9A-Za-z])[0-9]{13,19}+(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])(?:\([0-9]{2,4}\)|[0-9]{2,4}+)(?:[\x20.-]{1,2}+[0-9]{2,4}+){2,4}(?![0-9A-Za-z])",
}
# What a text must hold for the patterns to be tried at all.
HINT = {"email": r"@|[(\[]at[)\]]", "ip": r"[0-9]", "card": r"[0-9]", "phone": r"[0-9]"}
CONTEXT = (r"(?i)tel|phone|call|fax|mobil", r"(?i)card|visa|credit|pay", r"(?i)mail|contact|write|addr", r"(?i)\bip\b|host|server")
FEATURES = ("digits", "separators", "bracket", "luhn", "small", "groups", "left", "right", "context")
PRECISION = 0.95
TREES, RATE = 16, 0.3
SPAN = "array<struct<s:int,e:int,m:string,before:string,after:string>>"
AROUND = 24
PART = 256


def pieces(text: Column, pattern: str, when: Column) -> Column:
    """The matches ``m`` with the gaps before (``g``) and after (``n``) each, and a last gap alone."""
    gaps = F.split(text, pattern, -1)
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), gaps.alias("g"), F.slice(gaps, 2, F.size(gaps)).alias("n"))
    return F.when(when, found).otherwise(F.array().cast("array<struct<m:string,g:string,n:string>>"))


def laid_out(found: Column) -> Column:
    """Start and end of each match in code points, gaps and matches laid end to end.

    The matches are placed in parts of ``PART``, each from the summed length before it, so that a
    text of a hundred thousand matches is still placed in about linear time.
    """
    size = lambda x: F.length(x["g"]) + F.coalesce(F.length(x["m"]), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        start, end = acc["p"] + F.length(x["g"]), acc["p"] + size(x)
        row = F.struct(
            start.alias("s"), end.alias("e"), x["m"].alias("m"), F.right(x["g"], F.lit(AROUND)).alias("before"), F.left(x["n"], F.lit(AROUND)).alias("after")
        )
        return F.struct(end.alias("p"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(row))).alias("out"))

    def part(k: Column) -> Column:
        before = F.aggregate(F.slice(found, 1, k * PART), F.lit(0), lambda acc, x: acc + size(x))
        first = F.struct(before.alias("p"), F.array().cast(SPAN).alias("out"))
        return F.aggregate(F.slice(found, k * PART + 1, F.lit(PART)), first, step, lambda acc: acc["out"])

    parts = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / PART).cast("int"))
    return F.when(F.size(found) > 1, F.flatten(F.transform(parts, part))).otherwise(F.array().cast(SPAN))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def small_parts(m: Column) -> Column:
    return F.forall(F.split(m, "[^0-9]+"), lambda p: (p == "") | F.coalesce(p.try_cast("int") <= 255, F.lit(False)))


def valid(kind: str, m: Column) -> Column:
    n = F.length(digits(m))
    return {
        "email": F.lit(True),
        "ip": small_parts(m),
        "card": n.between(16, 19) & F.call_function("luhn_check", digits(m)),
        "phone": n.between(8, 15),
    }[kind]


def checked(kind: str, found: Column) -> Column:
    return F.filter(found, lambda x: valid(kind, x["m"]))


def meets(kind: str, x: Column) -> Column:
    """Whether a base span of the kind overlaps a candidate: more are found in the candidate and
    its surroundings together than in the surroundings alone."""

    def count(text: Column) -> Column:
        return F.size(F.filter(F.regexp_extract_all(text, F.lit(BASE[kind]), F.lit(0)), lambda m: valid(kind, m)))

    return count(F.concat(x["before"], x["m"], x["after"])) > count(x["before"]) + count(x["after"])


def based(docs: DataFrame) -> DataFrame:
    """doc_id, and per kind the base spans ``b_kind`` and the candidates ``w_kind``."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"mail": F.col("text").rlike(HINT["email"]), "number": F.col("text").rlike(HINT["ip"])})
    plus = F.contains("text", F.lit("+"))
    hints = {"email": F.col("mail"), "ip": F.col("number"), "card": F.col("number"), "phone": F.col("number")}
    found = {f"b_{k}": pieces(F.col("text"), BASE[k], hints[k] & plus if k == "phone" else hints[k]) for k in KINDS}
    found |= {f"w_{k}": pieces(F.col("text"), WIDE[k], hints[k]) for k in KINDS}
    rows = rows.select("doc_id", *[c.alias(name) for name, c in found.items()])
    rows = rows.select("doc_id", *[laid_out(F.col(name)).alias(name) for name in found])
    return rows.withColumns({f"b_{k}": checked(k, F.col(f"b_{k}")) for k in KINDS})


def described(kind: str) -> Column:
    """The candidates of a kind with their features, ``y``: whether one meets a base span of the
    kind, and ``any``: of any kind."""

    def side(char: Column) -> Column:
        return F.when(char.rlike(r"^[\p{L}\p{N}]"), 1).when(char.rlike(r"^\S"), 2).otherwise(0)

    def row(x: Column) -> Column:
        m, number = x["m"], digits(x["m"])
        topic = F.lit(0)
        for i, words in enumerate(CONTEXT, 1):
            topic = F.when(x["before"].rlike(words), i).otherwise(topic)
        values = {
            "digits": F.least(F.length(number), F.lit(24)),
            "separators": F.least(F.length(F.regexp_replace(m, r"[\p{L}\p{N}]", "")), F.lit(6)),
            "bracket": F.contains(m, F.lit("(")).cast("int"),
            "luhn": F.when(F.length(number) > 1, F.coalesce(F.call_function("luhn_check", number).cast("int"), F.lit(0))).otherwise(0),
            "small": small_parts(m).cast("int"),
            "groups": F.least(F.size(F.split(m, "[^0-9]+")), F.lit(6)),
            "left": side(F.right(x["before"], F.lit(1))),
            "right": side(F.left(x["after"], F.lit(1))),
            "context": topic,
        }
        own = meets(kind, x)
        other = [meets(k, x) for k in KINDS if k != kind]
        return F.struct(
            x["s"].alias("s"), x["e"].alias("e"), own.cast("int").alias("y"), (own | other[0] | other[1] | other[2]).cast("int").alias("any"),
            *[values[f].cast("int").alias(f) for f in FEATURES],
        )

    return F.transform(f"w_{kind}", row)


# ---------------------------------------------------------------------------- boosting


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(-g.sum() / (h.sum() + 1.0))


def _best_split(x: np.ndarray, g: np.ndarray, h: np.ndarray):
    best = (1e-6, None, None)
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        for value in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= value
            gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1.0) for s in (low, ~low)) - whole
            if gain > best[0]:
                best = (gain, f, int(value))
    return best


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A tree as nested (feature, value, low, high), or a leaf."""
    _, f, value = _best_split(x, g, h) if depth else (0, None, None)
    if f is None:
        return _leaf(g, h)
    low = x[:, f] <= value
    return (f, value, grow(x[low], g[low], h[low], depth - 1), grow(x[~low], g[~low], h[~low], depth - 1))


def tree_values(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, value, low, high = tree
    return np.where(x[:, f] <= value, tree_values(low, x), tree_values(high, x))


def boost(x: np.ndarray, y: np.ndarray, n: np.ndarray, trees: int = TREES, rate: float = RATE, depth: int = 2):
    """Boosted trees for the log odds of ``y`` over tuples ``x`` that stand for ``n`` rows each."""
    share = min(max(float((y * n).sum() / max(n.sum(), 1)), 1e-3), 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    score, out = np.full(len(x), bias), []
    for _ in range(trees if len(x) else 0):
        p = 1 / (1 + np.exp(-score))
        tree = grow(x, n * (p - y), n * p * (1 - p), depth)
        score += rate * tree_values(tree, x)
        out.append(tree)
    return bias, out


def calibrated(score: np.ndarray, y: np.ndarray, n: np.ndarray, precision: float = PRECISION) -> float | None:
    """The lowest score from which on the precision holds; None if there is none."""
    best = None
    order = np.argsort(-score)
    right = wrong = 0.0
    for k, i in enumerate(order):
        right, wrong = right + n[i] * y[i], wrong + n[i] * (1 - y[i])
        last = k + 1 == len(order) or score[order[k + 1]] < score[i]
        if last and right and right / (right + wrong) >= precision:
            best = float(score[i])
    return best


def learn(rows: DataFrame):
    """Per kind (bias, trees, threshold), from the counts of feature tuples of all documents."""
    models = {}
    every = None
    for kind in KINDS:
        part = rows.select((fold("doc_id", 5) == 0).alias("out"), F.explode(described(kind)).alias("c")).select(F.lit(kind).alias("kind"), "out", "c.y", *[f"c.{f}" for f in FEATURES])
        every = part if every is None else every.unionByName(part)
    found = every.groupBy("kind", "out", "y", *FEATURES).agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "out", "y", *FEATURES).collect()
    for kind in KINDS:
        own = [r for r in found if r["kind"] == kind]
        x = np.array([[r[f] for f in FEATURES] for r in own], float).reshape(-1, len(FEATURES))
        y, n, out = (np.array([r[c] for r in own], float) for c in ("y", "n", "out"))
        bias, trees = boost(x[out == 0], y[out == 0], n[out == 0])
        score = bias + RATE * sum((tree_values(t, x) for t in trees), np.zeros(len(x)))
        models[kind] = (bias, trees, calibrated(score[out == 1], y[out == 1], n[out == 1]))
    return models


def _expression(tree, x: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, value, low, high = tree
    return F.when(x[FEATURES[f]] <= value, _expression(low, x)).otherwise(_expression(high, x))


def _selected(kind: str, model) -> Column:
    bias, trees, least = model
    if least is None:
        return F.array().cast("array<struct<s:int,e:int>>")

    def chosen(x: Column) -> Column:
        score = F.lit(bias)
        for tree in trees:
            score = score + F.lit(RATE) * _expression(tree, x)
        return (score >= F.lit(least - 1e-9)) & (x["any"] == 0)

    picked = F.filter(described(kind), chosen)
    return F.transform(picked, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))


def find(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, the numbers of base spans, their digest, all spans."""
    rows = based(docs)
    models = learn(rows)
    plain = lambda c: F.transform(c, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    rows = rows.withColumns({f"a_{kind}": _selected(kind, models[kind]) for kind in KINDS})

    def named(kind: str, c: Column) -> Column:
        return F.transform(c, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))

    base = F.array_join(F.concat(*[named(k, F.col(f"b_{k}")) for k in KINDS]), ",")
    every = F.array_join(F.concat(*[named(k, F.array_sort(F.concat(plain(f"b_{k}"), F.col(f"a_{k}")))) for k in KINDS]), ",")
    counts = [F.size(f"b_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))
