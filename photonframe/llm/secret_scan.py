"""Secret scans: base patterns, and weak candidates linked to complementary parts.

Only DataFrame functions. A pattern's places come from the lengths of its matches and of the
text between them, summed up by a window over the match number. Base spans always stay.
Weak candidates are identifiers, bare 40-character keys and endpoints that say little alone.
They are joined by interval with the parts of other classes: both sides are dealt by
document and to every bin of ``reach`` code points that they cover, a candidate also to the
two beside these, and the condition compares the true distance. Matches of one pattern do
not overlap, so a bin holds a bounded number of parts and the join a bounded number of pairs
for each bin of a candidate. A weak secret needs an identifier near it, a weak identifier a secret,
an endpoint both.

Cases: null texts count as empty ones; a document without any span has zero counts and the
digest of the empty text; rows are told apart by a row number, so repeated rows and equal or
null ids each get their own result; two kinds may report overlapping spans, ordered by
start, then by kind as listed; texts may have any length, since only spans leave the scan;
columns other than id and text are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

# Kind, class, weak, pattern (no match may be empty), group whose length counts, least length.
KINDS = [
    ("assign", "secret", False, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "identifier", False, r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", "secret", False, r"[0-9a-f]{24,}", 0, 24),
    ("identifier", "identifier", True, r"""((?i:client_?id|access_?key(?:_?id)?|key_?id|account|user_?name|user|login))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 2, 3),
    ("key", "secret", True, r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/]*[0-9])(?=[A-Z0-9+/]*[a-z])(?=[a-z0-9+/]*[A-Z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])", 0, 40),
    ("endpoint", "endpoint", True, r"""(?:https?|jdbc:[a-z]+|s3|redis|postgres|postgresql|mysql|mongodb|amqp)://[^\x20\x09-\x0D"'<>]+""", 0, 8),
]
_ORDER = {kind: i for i, (kind, *_) in enumerate(KINDS)}


def _lengths(text: Column, pattern: str, group: int) -> Column:
    """Array of (gap, length, value): code points before each match since the last one, of
    the match, and of the group that counts; null without a match."""
    found = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length).alias("length"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length).alias("value"),
    )
    return F.when(text.rlike(pattern), found)


def parts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, hit) of all rows, with ``whole`` also doc, a struct of all columns; and
    their parts (row, kind, class, weak, start, end). hit: some pattern matches."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")] if whole else []
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text.alias("text"), *doc)
    found = materialize(source.select("row", "doc_id", *(["doc"] if whole else []), *(_lengths(F.col("text"), pattern, group).alias(kind) for kind, _, _, pattern, group, _ in KINDS)), "matches")
    each = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("found")) for kind in _ORDER))
    rows = found.select("row", F.explode(each).alias("x")).where("x.found is not null").select("row", "x.kind", F.posexplode("x.found").alias("n", "m")).select("row", "kind", "n", "m.*")
    before = Window.partitionBy("row", "kind").orderBy("n")
    end = F.sum(F.col("gap") + F.coalesce(F.col("length"), F.lit(0))).over(before)
    rows = rows.withColumn("end", end).where("length is not null").withColumn("start", F.col("end") - F.col("length"))
    kinds = reduce(lambda c, k: c.when(F.col("kind") == k[0], F.struct(F.lit(k[1]).alias("class"), F.lit(k[2]).alias("weak"), F.lit(k[5]).alias("least"))), KINDS[1:], F.when(F.col("kind") == KINDS[0][0], F.struct(F.lit(KINDS[0][1]).alias("class"), F.lit(KINDS[0][2]).alias("weak"), F.lit(KINDS[0][5]).alias("least"))))
    rows = rows.withColumn("k", kinds).where("value >= k.least")
    hit = F.coalesce(*_ORDER).isNotNull().alias("hit")
    return found.select("row", "doc_id", hit, *(["doc"] if whole else [])), rows.select("row", "kind", "k.class", "k.weak", "start", "end")


def linked(parts: DataFrame, reach: int = 256) -> DataFrame:
    """Weak candidates (row, kind, start, end) whose complementary parts are within reach."""
    first, last = F.expr(f"start div {reach}"), F.expr(f"end div {reach}")
    weak = parts.where("weak").withColumn("bin", F.explode(F.sequence(first - 1, last + 1)))
    other = parts.select("row", F.explode(F.sequence(first, last)).alias("bin"), F.col("class").alias("other"), F.col("start").alias("from"), F.col("end").alias("to")).where("other <> 'endpoint'")
    near = (F.col("from") - F.col("end") <= reach) & (F.col("start") - F.col("to") <= reach) & (F.col("other") != F.col("class"))
    has = lambda c: F.bool_or(F.col("other") == c)
    pairs = weak.join(other, ["row", "bin"]).where(near)
    kept = pairs.groupBy("row", "kind", "class", "start", "end").agg(has("identifier").alias("i"), has("secret").alias("s"))
    return kept.where("case class when 'secret' then i when 'identifier' then s else i and s end").select("row", "kind", "start", "end")


def _spans(parts: DataFrame, reach: int) -> DataFrame:
    """(row, spans): base spans and linked weak ones by start, then by kind as listed."""
    parts = materialize(parts, "parts")
    strong = parts.where("not weak").select("row", "kind", "start", "end")
    order = reduce(lambda c, k: c.when(F.col("kind") == k, _ORDER[k]), list(_ORDER)[1:], F.when(F.col("kind") == KINDS[0][0], 0))
    return strong.unionByName(linked(parts, reach)).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", order.alias("order"), "end", "kind"))).alias("spans"))


def scan(docs: DataFrame, reach: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row the counts of the base kinds, the digest of the base spans, and all spans."""
    ids, parts = parts_of(docs, id_col, text_col)
    spans = _spans(parts, reach)
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["order"] < 3)
    out = ids.join(spans, "row", "left").withColumn("spans", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)))
    count = lambda k: F.size(F.filter("spans", lambda x: x["order"] == k)).cast("long")
    counts = [count(_ORDER[kind]).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return out.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, reach: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with its columns, where each span in the text has become [kind]; of overlapping
    spans the first one's kind stands for all. n_chars, where there is one, follows."""
    rows, parts = parts_of(docs, id_col, text_col, whole=True)
    text = F.col(f"doc.`{text_col}`")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc, span):  # type: ignore[no-untyped-def]
        before = F.substring(text, acc["at"] + 1, F.greatest(span["start"] - acc["at"], F.lit(0)))
        mark = F.when(span["start"] >= acc["at"], F.concat(F.lit("["), span["kind"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.concat(acc["out"], before, mark).alias("out"), F.greatest(acc["at"], span["end"]).alias("at"))

    clean = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    hit = rows.where("hit").join(_spans(parts, reach), "row", "left").select("doc", F.coalesce(clean, text).alias("clean"))
    both = rows.where("not hit").select("doc", text.alias("clean")).unionByName(hit)  # rows without a match are not shuffled
    new = {text_col: F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return both.select(*((new[c] if c in new else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))
