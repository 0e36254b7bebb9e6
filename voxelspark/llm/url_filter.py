"""URL verdicts: host and path rules, then the ratio of two character language models.

URLs that a rule decides are the accepted and rejected examples. Each class has a Markov model
of variable order: after a context of up to ``ORDER`` characters, a seen character has its
Witten-Bell share, any other the rest times its chance after the shorter context. A URL without
a rule is accepted if its mean log-likelihood difference reaches a threshold, which is
calibrated on a fifth of the examples that the models have not seen.

Everything is DataFrame operations. URLs are reduced to 40 symbols, so that a model has at
most 40 ** (ORDER + 1) rows of a few bytes; that bound is why its tables may be broadcast.
Repeated URLs are scored once.

Nulls: a null url, or one without ``://``, has empty host and path and no rule, and is judged as
the empty text. Without examples of either class the ratio is 0 and everything is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelspark.llm.common import written

# The rules of the contract, (verdict, host/path).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
ORDER = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SYMBOLS = 40  # a-z, 0-9, '/', '.', '-' and one for everything else; '^' and '$' frame a text
FLAT = 0.5


def rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(rest(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits: its host or a subdomain of it, and the start of the path."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for verdict, name in rules:
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def symbols(url: Column) -> Column:
    """The text that the models read: 40 symbols, with a frame."""
    plain = F.regexp_replace(F.translate(rest(url), UPPER, LOWER), r"[^a-z0-9/.-]", "~")
    return F.concat(F.lit("^" * ORDER), plain, F.lit("$"))


def grams(texts: DataFrame) -> DataFrame:
    """A row per character of ``text``: the character after its context of ORDER characters."""
    places = F.sequence(F.lit(1), F.length("text") - ORDER)
    return texts.withColumn("place", F.explode(places)).withColumn("gram", F.expr(f"substring(text, place, {ORDER + 1})"))


def models(examples: DataFrame) -> list[tuple[DataFrame, DataFrame | None]]:
    """For each order k from 0: the log chances of every gram of k + 1 characters seen in either
    class (gram, a, r), and the log weights of what is unseen after a context (context, la, lr)."""
    counted = grams(examples).groupBy("gram").agg(
        *[F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0)).alias(name) for kind, name in (("allow", "na"), ("block", "nr"))]
    )
    counted = written(counted)
    total = counted.agg(F.sum("na").alias("na"), F.sum("nr").alias("nr")).first()
    out: list[tuple[DataFrame, DataFrame | None]] = []
    for k in range(ORDER + 1):
        own = counted.groupBy(F.expr(f"right(gram, {k + 1})").alias("gram")).agg(F.sum("na").alias("na"), F.sum("nr").alias("nr"))
        if k == 0:
            size = [(total[c] or 0) + FLAT * (SYMBOLS + 1) for c in ("na", "nr")]
            logs = [F.log((F.col(c) + FLAT) / s).alias(x) for c, s, x in (("na", size[0], "a"), ("nr", size[1], "r"))]
            out.append((written(own.select("gram", *logs)), None))
            continue
        own = own.withColumn("context", F.expr(f"left(gram, {k})"))
        contexts = own.groupBy("context").agg(
            *[F.sum(c).alias(f"s{c}") for c in ("na", "nr")], *[F.sum((F.col(c) > 0).cast("int")).alias(f"t{c}") for c in ("na", "nr")]
        )

        def unseen(c: str) -> Column:
            s, t = F.col(f"s{c}"), F.col(f"t{c}")
            return F.when(s > 0, t / (s + t)).otherwise(1.0)

        shorter, _ = out[-1]
        lower = shorter.select(F.col("gram").alias("tail"), F.col("a").alias("pa"), F.col("r").alias("pr"))
        joined = own.join(contexts, "context").join(lower, F.expr(f"right(gram, {k})") == F.col("tail"))
        logs = [
            F.log(F.when(F.col(f"s{c}") > 0, F.col(c) / (F.col(f"s{c}") + F.col(f"t{c}"))).otherwise(0.0) + unseen(c) * F.exp(p)).alias(x)
            for c, p, x in (("na", "pa", "a"), ("nr", "pr", "r"))
        ]
        table = written(joined.select("gram", *logs))
        out.append((table, written(contexts.select("context", F.log(unseen("na")).alias("la"), F.log(unseen("nr")).alias("lr")))))
    return out


def scored(texts: DataFrame, tables: list[tuple[DataFrame, DataFrame | None]]) -> DataFrame:
    """``text`` and ``score``: mean log-likelihood difference, accepted less rejected."""
    rows = grams(texts.select("text"))
    difference = F.lit(0.0)
    for k, (table, contexts) in enumerate(tables):
        seen = table.select(F.col("gram").alias(f"g{k}"), (F.col("a") - F.col("r")).alias(f"d{k}"))
        rows = rows.join(F.broadcast(seen), F.expr(f"right(gram, {k + 1})") == F.col(f"g{k}"), "left")
        if contexts is not None:
            after = contexts.select(F.col("context").alias(f"c{k}"), (F.col("la") - F.col("lr")).alias(f"w{k}"))
            rows = rows.join(F.broadcast(after), F.expr(f"left(right(gram, {k + 1}), {k})") == F.col(f"c{k}"), "left")
            difference = difference + F.coalesce(f"w{k}", F.lit(0.0))
        difference = F.coalesce(f"d{k}", difference)
    return rows.groupBy("text").agg(F.avg(difference).alias("score"))


def threshold(found: DataFrame) -> float:
    """The score with the best balanced accuracy on rows (score, kind, n), in steps of 0.01."""
    bins = F.round(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col("score"))), 2)
    rows = found.groupBy(bins.alias("bin")).agg(
        F.sum(F.when(F.col("kind") == "allow", F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("kind") == "block", F.col("n")).otherwise(0)).alias("r")
    )
    bins = sorted((r["bin"], r["a"], r["r"]) for r in rows.collect())  # 4,001 bins at most
    allow, block = sum(b[1] for b in bins) or 1, sum(b[2] for b in bins) or 1
    best, at, passed, stopped = (0.5, 0.0), 0.0, allow, 0
    for bin_, a, r in bins:  # the threshold just above this bin
        passed, stopped = passed - a, stopped + r
        accuracy = (passed / allow + stopped / block) / 2
        if accuracy > best[0] + 1e-12:
            best = (accuracy, bin_ + 0.005)
    return best[1] if best[0] > 0.5 else at


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, score."""
    url = F.coalesce(F.col("url"), F.lit(""))
    rows = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), symbols(url).alias("text"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("kind", verdict_of(F.col("rule"), rules))
    texts = written(rows.groupBy("text").agg(F.count("kind").alias("n"), F.max("kind").alias("kind")))
    unseen = F.crc32(F.col("text").cast("binary")) % 5 == 0
    examples = texts.where(F.col("kind").isNotNull())
    found = written(scored(texts, models(examples.where(~unseen))))
    least = threshold(examples.where(unseen).join(found, "text"))
    judged = F.when(F.col("score") >= least, F.lit("allow")).otherwise("block")
    return rows.join(found, "text").select("page_id", "host", "path", "rule", F.coalesce("kind", judged).alias("verdict"), "score")
