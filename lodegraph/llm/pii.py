"""Personal data: pattern matches, and terms that give protected values away. DataFrame operations only.

Base spans, leftmost and non-overlapping for each kind: email, ip (parts at most 255), card (12 to 19 digits that
pass the Luhn test), phone (9 to 15 digits). Their values are protected. Terms (words of four letters or more,
lower-cased) are counted over whole documents: n(t, v) documents that hold term t and value v, n(t) documents with
t, n(v) with v, N in all. Disclosure is the pointwise mutual information of t and v over the information of v:
ln(P(v|t) / P(v)) / ln(1 / P(v)), with P(v) = n(v) / N and P(v|t) smoothed by PRIOR documents in which v is as
frequent as in all: (n(t, v) + PRIOR P(v)) / (n(t) + PRIOR). It nears 1 if t occurs with v alone, the more often the
nearer. A term whose disclosure of any value is at least DISCLOSURE is a span of kind "term" wherever it occurs.

Null and empty texts have no spans. Repeated rows count as documents each and get equal results; ids may be null;
other columns do not matter, whatever their names; an empty table gives an empty result. Places count code points,
ends are exclusive.

Scale: patterns are possessive or anchored, so that matching takes linear time and no deep stack. Terms of the whole
corpus are counted with partial aggregation. Pairs are made only of terms whose documents hold values often enough
for the threshold to be reached by some value. What is broadcast is counted first, in rows and in bytes, and joined
by a shuffle if larger; then texts that are repeated over HOT times are joined in SALTS parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpoint, join_repeated, small

KINDS = ["email", "ip", "card", "phone", "term"]
PRIOR, DISCLOSURE = 1.0, 0.9
HOT, SALTS = 1000, 16

PATTERNS = {
    # A run of name characters is entered at its start, or where the last match ended.
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_TERM = r"(?<![\p{L}\p{N}@._%+-])\p{L}{4,}+(?![\p{N}@_%+-])"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(q := F.regexp_replace(p, "^0+", "")) <= 3) & (F.when(F.length(q) <= 3, F.concat(F.lit("0"), q).cast("int")).otherwise(999) <= 255))
    n = F.length(_digits(value))
    if kind == "card":
        return (n >= 12) & (n <= 19) & F.when((n >= 12) & (n <= 19), _luhn(_digits(value))).otherwise(False)
    return (n >= 9) & (n <= 15)


def _filter(kind: str):
    return lambda s: _passes(kind, s["value"])


def _of_kind(k: int):
    return lambda s: s["kind"] == k


#: What a text must hold to be searched for a kind at all.
_MAY = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}

_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _places(text: Column, pattern: str, kind: int, only: Column | None = None) -> Column:
    """All matches with their places, or those whose lower-cased values are in the array only: the parts between
    matches and the matches add up to the text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["gap"])
        b = a + F.length(x["m"])
        more = F.concat(acc["spans"], F.array(F.struct(a.alias("start"), F.lit(kind).alias("kind"), b.alias("end"), x["m"].alias("value"))))
        if only is not None:
            more = F.when(F.array_contains(only, F.lower(x["m"])), more).otherwise(acc["spans"])
        return F.struct(b.alias("at"), more.alias("spans"))

    pairs = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
    return F.aggregate(pairs, start, step, lambda acc: acc["spans"])


def base_spans(text: Column) -> Column:
    """array of (start, kind, end, value), in order; an empty array for null."""
    none = F.array().cast(_SPAN)
    parts = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        found = F.filter(_places(text, pattern, k), _filter(kind))
        parts.append(F.when(_MAY[kind](text), found).otherwise(none))
    return F.coalesce(F.array_sort(F.concat(*parts)), none)


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0)))


def revealing(docs: DataFrame, text_col: str = "text", prior: float = PRIOR, disclosure: float = DISCLOSURE) -> DataFrame:
    """The terms that give values away, as a checkpoint."""
    t = F.col(text_col)
    held = docs.select(t.alias("text"), base_spans(t).alias("base")).filter(F.size("base") > 0)
    held = checkpoint(held.select(F.array_distinct(F.transform("base", lambda s: F.lower(s["value"]))).alias("values"), _terms(F.col("text")).alias("terms")))
    values = held.select(F.explode("values").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n_v"))
    with_any = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_held"))
    in_all = docs.select(F.explode(_terms(t)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    n = docs.count()
    # P(v|t) has to be P(v) to the power of 1 - disclosure at least, hence this power of 1 / N whatever the value.
    most = (F.col("n_held") + prior) / (F.col("n_t") + prior)
    able = checkpoint(in_all.join(with_any, "term").filter(most >= (1 - 1e-9) * float(max(n, 1)) ** (disclosure - 1)).select("term", "n_t"))
    pairs = held.select(F.explode("terms").alias("term"), "values").join(broadcast_if_small(able), "term")
    together = pairs.select("term", "n_t", F.explode("values").alias("value")).groupBy("term", "n_t", "value").agg(F.count(F.lit(1)).alias("n_tv"))
    p = F.col("n_v") / F.lit(float(max(n, 1)))
    given = (F.col("n_tv") + F.lit(prior) * p) / (F.col("n_t") + prior)
    # A value in every document says nothing that a term could give away.
    found = together.join(values, "value").filter((F.col("n_v") < n) & (F.log(given / p) >= -F.lit(disclosure) * F.log(p)))
    return checkpoint(found.select("term").distinct())


def spans(docs: DataFrame, text_col: str = "text", **kinds) -> DataFrame:
    """docs with the column __spans: array of (start, kind, end), base spans and terms, in order. The columns of docs
    should not begin with two underscores; report and sanitise see to that."""
    found = revealing(docs, text_col, **kinds)
    t = F.col(text_col)
    none = F.array().cast("array<string>")
    if found.isEmpty():
        out = docs.withColumn("__terms", none)
    else:
        hashes = checkpoint(found.select(F.xxhash64("term").alias("h")).distinct())
        words = docs.select(F.xxhash64(t).alias("__key"), F.explode(_terms(t)).alias("term")).withColumn("h", F.xxhash64("term"))
        # Texts of equal hashes share their terms, which are to be masked in either.
        hits = words.join(broadcast_if_small(hashes), "h", "left_semi").join(found, "term", "left_semi")
        each = hits.groupBy("__key", "term").agg(F.count(F.lit(1)).alias("n"))
        sets = checkpoint(each.groupBy("__key").agg(F.collect_list("term").alias("__terms"), F.max("n").alias("n")))
        keyed = docs.withColumn("__key", F.xxhash64(t))
        if small(sets, 100_000):
            out = keyed.join(F.broadcast(sets.drop("n")), "__key", "left")
        else:
            out = join_repeated(keyed, sets, "__key", "n", HOT, SALTS)
        out = out.drop("__key").withColumn("__terms", F.coalesce("__terms", none))
    words = _places(t, _TERM, KINDS.index("term"), F.col("__terms"))
    extra = F.when(F.size("__terms") > 0, words).otherwise(F.array().cast(_SPAN))
    plain = F.transform(F.array_sort(F.concat(base_spans(t), extra)), lambda s: F.struct(s["start"], s["kind"], s["end"]))
    return out.withColumn("__spans", plain).drop("__terms")


def joined(some: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def report(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **kinds) -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of each row."""
    found = spans(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), "t", **kinds)
    some = F.col("__spans")
    base = F.filter(some, lambda s: s["kind"] < 4)
    counts = [F.size(F.filter(some, _of_kind(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    return found.select(F.col("i").alias(id_col), *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(some).alias("spans"))


def sanitise(docs: DataFrame, text_col: str = "text", terms: str = "generalise", **kinds) -> DataFrame:
    """docs with the same columns; base spans become <EMAIL>, <IP>, <CARD>, <PHONE>. Revealing terms are generalised
    to their class, <NAME> for those with a capital first and <TERM> for others, of which so many occur that they give
    no value away; or removed, with terms="remove". Spans that overlap become one, by the first one's kind."""
    if terms not in ("generalise", "remove"):
        raise ValueError(f"terms {terms!r} is neither generalise nor remove")
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    text = f"c{names.index(text_col)}"
    found = spans(plain, text, **kinds)
    marks = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS[:-1]))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"])
        first = F.substring(F.col(text), s["start"] + 1, F.lit(1))
        general = F.when(first != F.lower(first), "<NAME>").otherwise("<TERM>") if terms == "generalise" else F.lit("")
        mark = F.when(s["kind"] < len(KINDS) - 1, F.get(marks, s["kind"])).otherwise(general)
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(gap, mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    clean = F.aggregate("__spans", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col(text), acc["at"] + 1, F.length(F.col(text)))))
    new = F.when(F.size("__spans") > 0, clean).otherwise(F.col(text))
    return found.select(*((new if f"c{i}" == text else F.col(f"c{i}")).alias(x) for i, x in enumerate(names)))
