"""URL filters: host and path rules first, then association rules mined by FP-growth.

Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path: from there up to ?, # or the end. A null
URL or one without :// has neither, and only a rule of an empty host could fit it. A host and path rule fits its host
and all subdomains where the URL's path starts with the rule's; of those that fit, the longest wins.

URLs that no such rule decides are judged by mined rules. A URL's tokens are facts, one each: its scheme, the host's
labels, path segments (numbers as one token), query keys and the fragment. Labelled URLs are transactions of their
tokens and, if bad, the label; tokens that all of them have tell nothing and are left out. Rules "tokens -> bad" stay if

- they hold in at least FLOOR labelled rows, and in the share SUPPORT of all,
- at least CONFIDENCE of the rows with the tokens are bad, and
- chance explains that with a probability of at most ALPHA over all rules that were tested: by Chernoff's bound, the
  rows times the divergence of confidence and overall share of bad rows have to reach ln(rules / ALPHA),

unless a part of their tokens is a rule already. A URL is blocked if it holds all tokens of a rule, found through an
inverted index by the rule's rarest token; else it is allowed. Without labelled rows, or rules, all such URLs are
allowed, and so they are if all labelled rows are bad, or none.

Repeated rows get a result each, and repeated labelled rows count each; null ids and clashing column names do not
matter, empty tables give empty results.

Scale: judging is one pass without a shuffle as long as the rules number at most RULES and have at most RULE_BYTES,
which is checked; beyond that, distinct URLs meet rules by the rule's rarest token, which few URLs have. Mining is
distributed and covers every labelled row; its floor bounds the number of itemsets.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_batches

RULES, RULE_BYTES = 50_000, 16_000_000
SUPPORT, FLOOR, CONFIDENCE, ALPHA = 0.002, 10, 0.6, 0.01
_BAD = "label=bad"


def host(url: Column) -> Column:
    """After the first ://; empty without one. The pattern takes no line ends for the end."""
    h = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(h, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule(h: Column, p: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest of the (verdict, host, path) rules that fits, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, rh, rp in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((h == rh) | F.endswith(h, F.lit("." + rh))) & F.startswith(p, F.lit(rp))
        name, verdict = F.when(fits, rh + rp).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def tokens(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    some = lambda name, values: F.transform(F.filter(values, lambda x: x != ""), lambda x: F.concat(F.lit(name), x))
    segments = F.transform(F.split(path(u), "/"), lambda x: F.regexp_replace(x, "[0-9]+", "0"))
    keys = F.regexp_extract_all(u, F.lit(r"[?&]([^=&#]+)"), F.lit(1))
    rest = F.array(F.regexp_extract(u, r"\A([A-Za-z]+)://", 1))
    fragment = F.array(F.regexp_extract(u, "#(.*)", 1))
    return F.array_distinct(F.concat(some("host=", F.split(host(u), r"\.")), some("path=", segments), some("key=", keys), some("scheme=", rest), some("fragment=", fragment)))


def mine(labelled: DataFrame, url_col: str = "url", bad_col: str = "bad", support: float = SUPPORT, confidence: float = CONFIDENCE, floor: int = FLOOR, alpha: float = ALPHA) -> DataFrame:
    """tokens (sorted), n (labelled rows with them), n_bad (bad ones of these) and confidence of the rules, from rows
    of URLs with a boolean label."""
    spark = labelled.sparkSession
    rows = checkpoint(labelled.filter(F.col(bad_col).isNotNull()).select(tokens(F.col(url_col)).alias("items"), F.col(bad_col).alias("bad")))
    total, bad = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0))).first()
    none = spark.createDataFrame([], "tokens array<string>, n bigint, n_bad bigint, confidence double")
    if not 0 < bad < total or bad < floor * confidence:
        return none
    frequency = rows.select(F.explode("items").alias("token")).groupBy("token").count()
    # At most the tokens of one URL.
    everywhere = [r[0] for r in frequency.filter(F.col("count") == total).select("token").collect()]
    items = F.array_except("items", F.array(*(F.lit(t) for t in everywhere)).cast("array<string>"))
    rows = checkpoint(rows.select(F.when(F.col("bad"), F.concat(items, F.array(F.lit(_BAD)))).otherwise(items).alias("items")))
    # The itemset with the label has to be as frequent as a rule of the floor and least confidence.
    least = max(floor * confidence, support * total * confidence, 1) / total
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least), minConfidence=confidence, numPartitions=parts).fit(rows)
    tested = model.associationRules.filter(F.col("consequent")[0] == _BAD)
    tested = tested.select(F.array_sort("antecedent").alias("tokens"), F.round(F.col("support") * total).cast("bigint").alias("n_bad"), "confidence")
    tested = checkpoint(tested.withColumn("n", F.round(F.col("n_bad") / F.col("confidence")).cast("bigint")))
    # All itemsets with the label were tested, also those whose confidence is too small.
    many = max(1, model.freqItemsets.filter(F.array_contains("items", _BAD)).count())
    p, q = F.lit(bad / total), F.col("confidence")
    gap = q * F.log(q / p) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0)
    sure = (q > p) & (F.col("n") * gap >= float(np.log(many / alpha)))
    found = tested.filter((F.col("n") >= max(floor, support * total)) & sure)
    return found.select("tokens", "n", "n_bad", "confidence")


def _minimal(rules: list[frozenset[str]]) -> list[frozenset[str]]:
    """Rules no part of which is a rule."""
    kept: list[frozenset[str]] = []
    index = defaultdict(list)
    for r in sorted(set(rules), key=lambda r: (len(r), sorted(r))):
        seen = defaultdict(int)
        for t in r:
            for i in index[t]:
                seen[i] += 1
        if r and not any(n == len(kept[i]) for i, n in seen.items()):
            for t in r:
                index[t].append(len(kept))
            kept.append(r)
    return kept


def blocked(urls: DataFrame, rules: DataFrame, url_col: str, most: int = RULES) -> DataFrame:
    """urls with the boolean column blocked, under the names k0, k1, ... and hit."""
    rules = checkpoint(rules.select("tokens"))
    names = urls.columns
    plain = urls.toDF(*(f"k{i}" for i in range(len(names))))
    url = F.col(f"k{names.index(url_col)}")
    size = F.aggregate("tokens", F.lit(0), lambda a, x: a + F.octet_length(x))
    number, total = rules.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    if number > most or total > RULE_BYTES:
        each = checkpoint(plain.select(url.alias("u")).distinct().select("u", tokens(F.col("u")).alias("items")))
        used = rules.select(F.explode("tokens").alias("token")).distinct()
        counts = each.select(F.explode("items").alias("token")).join(used, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("m"))
        # A rule with a token that no URL has fits none: it needs all of its tokens here.
        by_token = rules.withColumn("r", F.monotonically_increasing_id()).select("r", "tokens", F.explode("tokens").alias("token")).join(counts, "token")
        rarest = by_token.groupBy("r").agg(F.count(F.lit(1)).alias("n"), F.min_by("token", F.struct("m", "token")).alias("token"), F.first("tokens").alias("tokens")).filter(F.col("n") == F.size("tokens")).select("token", "tokens")
        met = each.select("u", "items", F.explode("items").alias("token")).join(checkpoint(rarest), "token")
        hit = met.filter(F.forall("tokens", lambda t: F.array_contains("items", t))).select("u").distinct().withColumn("hit", F.lit(True))
        return plain.join(hit, url == F.col("u"), "left").select(*plain.columns, F.coalesce("hit", F.lit(False)).alias("hit"))
    kept = _minimal([frozenset(r[0]) for r in rules.collect()])
    index = defaultdict(list)
    for i, r in enumerate(kept):
        for t in r:
            index[t].append(i)
    sizes, index = [len(r) for r in kept], dict(index)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for some in b.column(b.num_columns - 1).to_pylist():
            seen, hit = defaultdict(int), False
            for t in some or ():
                for i in index.get(t, ()):
                    seen[i] += 1
                    hit = hit or seen[i] == sizes[i]
            out.append(hit)
        return pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.bool_())], names=[*(f"k{i}" for i in range(b.num_columns - 1)), "hit"])

    rows = plain.withColumn("items", tokens(url))
    return map_batches(rows, run, ", ".join([*(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(urls.schema)), "hit boolean"]))


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", id_col: str = "page_id", support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """id, host, path, rule and verdict of every row; labelled: url and bad."""
    out = blocked(pages.select(F.col(id_col), F.col(url_col)), mine(labelled, support=support, confidence=confidence), url_col).toDF("i", "u", "hit")
    h, p = host(F.col("u")), path(F.col("u"))
    name, verdict = rule(h, p, rules)
    own = F.when(F.col("hit"), "block").otherwise("allow")
    return out.select(F.col("i").alias(id_col), h.alias("host"), p.alias("path"), name.alias("rule"), F.coalesce(verdict, own).alias("verdict"))
