"""Quality rules: base counts of a text and perplexity bands of an n-gram model.

The model is an interpolated modified Kneser-Ney model over UTF-8 bytes, of order six, one
for each language. Tasks count the n-grams of whole texts, Spark adds the counts up, and
discounts, continuation counts, context weights and probabilities are DataFrame aggregates,
windows over a context's 256 n-grams at most and joins over all counts. Every n-gram has its
own probability, however rare it is. The logarithms of the common ones (``RARE``, ``SHARE``, at
most ``HOT``) are broadcast, in arrays sorted by n-gram key (64 bits, the bytes themselves: a hash
without collisions); what a text has of the others is written beside it and joined with the table
of all. No such n-gram is common, so neither join has a hot key. A score does not depend on
which are broadcast.
A text's score is its negative log-probability for each of its words, that is the logarithm
of its perplexity by word, summed in whole ten-thousandths of a nat, so that it does not
depend on order.

Each language has its own lower and upper band, from the exact quartiles of its documents
that pass the base rules. Scores are taken as distances from the language's median, divided
by sqrt(1 + SHORT / words) because the mean over few words varies more; the bands lie
``below`` and ``above`` interquartile ranges beyond the quartiles of these. The lower band is
the wider one: texts with many copies are well known to the model without being bad.

A text is part of what the model has counted, so odd ones are half known to it.

Cases: a null text has no words and fails; an unknown (null) language is a language of its
own; a language without documents that pass has no bands, and then nothing in it is kept;
a language whose scores are all equal keeps them all; very long texts are scored in slices;
empty tables give no rows; only the id, text and language columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, release, words_of

ORDER = 6
HOT = 1 << 21  # n-grams that are broadcast at most, the others are joined
RARE = 4  # n-grams seen less often are joined, however few they are
SHARE = 1 << 26  # so are those that are seen less than once in so many bytes
FINE = 64  # parts of n-grams seen equally often
SCALE = 10_000
SHORT = 1_000
LANGUAGES = 100_000  # rows of bands that are broadcast at most
STEP = 1_000  # scores are compared in thousandths, so a language has few different ones
SLICE = 1 << 20
HELD = 1 << 21  # different n-grams of a language that a counting task holds at most
SYMBOLS = "#*$%&|<>"  # fixed values
SPACES = " \t\n\v\f\r"  # fixed values


def _lang(c: Column) -> Column:
    """A language's name, null told from all names."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def _codes(raw: bytes, order: int) -> np.ndarray:
    """Key of the n-gram that begins at each byte."""
    b = np.frombuffer(raw, np.uint8).astype(np.int64)
    n = len(b) - order + 1
    out = b[:n].copy()
    for j in range(1, order):
        out <<= 8
        out |= b[j : j + n]
    return out


def _blocks(texts: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of several texts at a time, about SLICE bytes: which text, how many bytes, and the
    n-gram that ends at each byte. A longer text comes in several parts; line ends stand
    before each text."""
    before = order - 1
    held: list[bytes] = []
    rows: list[int] = []
    lengths: list[int] = []

    def block() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ends = np.cumsum(np.fromiter(map(len, held), np.int64, len(held)))
        codes = _codes(b"".join(held), order)
        across = (ends[:-1, None] - np.arange(1, before + 1)).ravel() if before else np.zeros(0, np.int64)
        return np.array(rows), np.array(lengths), np.delete(codes, across) if len(across) else codes

    size = 0
    for i, raw in enumerate(texts):
        for at in range(0, len(raw), SLICE):
            context = (b"\n" * before + raw[max(0, at - before) : at])[-before:] if before else b""
            held.append(context + raw[at : at + SLICE])
            rows.append(i)
            lengths.append(len(held[-1]) - before)
            size += lengths[-1]
            if size >= SLICE:
                yield block()
                held, rows, lengths, size = [], [], [], 0
    if held:
        yield block()


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def count_grams(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram long, n long) over all rows (lang, text), lang not null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size: dict[str, int] = {}

        def emit(lang: str) -> Iterator[pa.RecordBatch]:
            keys, counts = _merged(held.pop(lang))
            size.pop(lang)
            for at in range(0, len(keys), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(keys[part])), pa.array(keys[part]), pa.array(counts[part])], names=["lang", "gram", "n"])

        for batch in batches:
            for lang, own in _by_language(batch.column(0).to_pylist(), [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]):
                for _, _, codes in _blocks([raw for _, raw in own], order):
                    held.setdefault(lang, []).append(np.unique(codes, return_counts=True))
                    size[lang] = size.get(lang, 0) + len(held[lang][-1][0])
                    if size[lang] > HELD:
                        held[lang] = [_merged(held[lang])]
                        size[lang] = len(held[lang][0][0])
                        if 2 * size[lang] > HELD:
                            yield from emit(lang)
            while sum(size.values()) > 2 * HELD:  # many languages
                yield from emit(max(size, key=size.__getitem__))
        for lang in list(held):
            yield from emit(lang)

    return texts.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _by_language(langs: list[str], texts: list[bytes]) -> list[tuple[str, list[tuple[int, bytes]]]]:
    found: dict[str, list[tuple[int, bytes]]] = {}
    for i, (lang, raw) in enumerate(zip(langs, texts, strict=True)):
        if raw:
            found.setdefault(lang, []).append((i, raw))
    return list(found.items())


def discount_columns() -> Column:
    """[D1, D2, D3+] of columns n1 to n4, the counts of counts; 0.5, 1 and 1.5 where they are
    undefined."""
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    of = lambda i: F.least(F.greatest(i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"), F.lit(0.0)), F.lit(float(i)))
    known = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)
    return F.when(known, F.array(of(1), of(2), of(3))).otherwise(F.array(F.lit(0.5), F.lit(1.0), F.lit(1.5)))


class Model:
    """For each language and order: sorted keys with log-probabilities, sorted contexts with
    the logarithm of the weight that they give to the lower order; in 1 / SCALE nats."""

    def __init__(self, order: int) -> None:
        self.order = order
        self.levels: dict[str, dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = {}

    def log_probability(self, lang: str, codes: np.ndarray) -> np.ndarray:
        """Of the last byte of each n-gram after the others."""
        total = np.zeros(len(codes), np.int64)
        levels, todo = self.levels.get(lang, {}), np.arange(len(codes))
        for k in range(self.order, 0, -1):
            if k not in levels:
                continue
            keys, logp, contexts, rest = levels[k]
            code = codes[todo] & ((1 << 8 * k) - 1)
            at = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
            hit = keys[at] == code
            total[todo[hit]] += logp[at[hit]]
            todo, code = todo[~hit], code[~hit] >> 8
            if not len(todo):
                return total
            at = np.minimum(np.searchsorted(contexts, code), len(contexts) - 1)
            total[todo] += np.where(contexts[at] == code, rest[at], 0)
        total[todo] += round(-np.log(256) * SCALE)
        return total


def _levels(texts: DataFrame, order: int) -> tuple[list[DataFrame], DataFrame, int]:
    """Of all rows (lang, text), lang not null: (lang, gram, n, raw) of each order, the highest
    first; (lang, k, cuts, total), the discounts by order and the language's bytes; how many languages."""
    levels = [materialize(count_grams(texts, order).withColumn("raw", F.col("n")), "grams")]
    for k in range(order - 1, 0, -1):  # n: in how many contexts; raw: how often
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))
        levels.append(materialize(levels[-1].groupBy("lang", suffix.alias("gram")).agg(F.count("*").alias("n"), F.sum("raw").alias("raw")), "grams"))
    every = reduce(DataFrame.unionByName, (x.withColumn("k", F.lit(order - i)) for i, x in enumerate(levels)))
    n = F.col("n")
    facts = every.groupBy("lang", "k").agg(F.sum(F.when(F.col("k") == order, n)).alias("own"), *(F.count_if(n == i).alias(f"n{i}") for i in (1, 2, 3, 4)))
    facts = materialize(facts.select("lang", "k", "own", discount_columns().alias("cuts")), "facts")  # a row for each language and order
    totals = facts.where(F.col("own").isNotNull()).select("lang", F.col("own").alias("total"))
    languages = totals.count()
    facts = facts.drop("own").join(totals, "lang")
    return levels, F.broadcast(facts) if languages <= LANGUAGES else facts, languages


def log_probabilities(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram long, n long, logp int) of every n-gram of all rows (lang, text), lang not
    null: modified Kneser-Ney, in 1 / SCALE nats. Stored."""
    levels, facts, _ = _levels(texts, order)
    release(texts.sparkSession)
    n, cut = F.col("n"), lambda i: F.element_at("cuts", i)
    inside = Window.partitionBy("lang", F.expr("gram div 256"))  # 256 rows at most
    often = lambda which: F.count_if(which).over(inside)
    lower = None
    for k, level in enumerate(reversed(levels), 1):
        all_ = F.sum(n).over(inside)
        given = cut(1) * often(n == 1) + cut(2) * often(n == 2) + cut(3) * often(n > 2)  # what the discounts leave to the lower order
        own = level.join(facts.where(F.col("k") == k).select("lang", "cuts"), "lang")
        own = own.select("lang", "gram", "n", ((n - cut(F.least(n, F.lit(3)).cast("int"))) / all_).alias("own"), (given / all_).alias("rest"))
        if lower is None:
            own = own.withColumn("below", F.lit(1 / 256))
        else:  # each n-gram's last k - 1 bytes are there, after 256 bytes at most
            own = own.withColumn("tail", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(lower, ["lang", "tail"])
        p = F.col("own") + F.col("rest") * F.col("below")
        lower = own.select("lang", F.col("gram").alias("tail"), p.alias("below"), "n")
        if k < order:
            lower = lower.drop("n")
    logp = F.rint(F.log(F.greatest(F.col("below"), F.lit(1e-12))) * SCALE).cast("int")
    out = materialize(lower.select("lang", F.col("tail").alias("gram"), "n", logp.alias("logp")), "logp")
    discard(*levels)
    release(texts.sparkSession)
    return out


def commonest(grams: DataFrame, most: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Of rows (lang, gram, n, logp) those seen RARE times or more and at least once in SHARE
    bytes of all, but at most ``most``, the most often seen first: sorted keys and logarithms by
    language. Rows are taken by classes of n, of which a part may be taken. So their number does
    not grow with the table, and the rest is about the same part of each text at every size."""
    place = F.floor(F.log2("n") * 8) * FINE + F.pmod(F.xxhash64("lang", "gram"), F.lit(FINE))
    classes = grams.groupBy(place.alias("place")).agg(F.count("*").alias("grams"), F.sum("n").alias("bytes")).orderBy(F.desc("place")).collect()  # 8 * 64 * FINE rows at most
    lowest = FINE * int(np.log2(max(RARE, sum(r.bytes for r in classes) / SHARE)) * 8)
    least, size = None, 0
    for r in classes:
        size += r.grams
        if size > most or r.place < lowest:
            break
        least = r.place
    return {} if least is None else _by_language_sorted(grams.where(place >= least).select("lang", "gram", "logp"))


def _by_language_sorted(rows: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Of rows (lang, gram, logp): sorted keys and logarithms by language. The driver is sent
    twelve bytes a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, keys, logp = batch.column(0).dictionary_encode(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            code = langs.indices.to_numpy()
            own = [np.flatnonzero(code == i) for i in range(len(langs.dictionary))]
            yield pa.RecordBatch.from_arrays([langs.dictionary, *(pa.array([c[x].tobytes() for x in own], pa.binary()) for c in (keys, logp))], names=["lang", "keys", "logp"])

    parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for lang, keys, logp in zip(*(c.to_pylist() for c in rows.mapInArrow(run, "lang string, keys binary, logp binary").toArrow().columns), strict=True):
        parts.setdefault(lang, []).append((np.frombuffer(keys, np.int64), np.frombuffer(logp, np.int32)))
    found = {}
    for lang in list(parts):
        keys, logp = (np.concatenate(c) for c in zip(*parts.pop(lang), strict=True))
        order = np.argsort(keys)
        found[lang] = keys[order], logp[order]
    return found


def fit(texts: DataFrame, order: int = ORDER, share: int | None = None) -> Model:
    """A model that the driver holds, for texts that are not in the table: modified Kneser-Ney
    over all rows (lang, text), lang not null, with every n-gram. ``quality`` does not use it.
    With ``share`` it is one of bounded size: of L languages each stores the n-grams that make up
    at least L in ``share`` of its own bytes, and what is not stored has its mass given to the
    lower orders."""
    levels, facts, languages = _levels(texts, order)
    model = Model(order)
    if not languages:
        discard(*levels)
        return model
    n = F.col("n")
    every = reduce(DataFrame.unionByName, (x.withColumn("k", F.lit(order - i)) for i, x in enumerate(levels))).join(facts, ["lang", "k"])
    kept = F.lit(True) if share is None else F.col("raw") * max(1, share // languages) >= F.col("total")  # so often has each n-gram been seen that a stored one begins or ends with
    every = every.withColumns({"left": F.greatest(n - F.element_at("cuts", F.least(n, F.lit(3)).cast("int")), F.lit(0.0)), "kept": kept})
    sums = every.groupBy("k", "lang", F.expr("gram div 256").alias("key")).agg(F.sum(n).alias("all"), F.sum(F.when(F.col("kept"), F.col("left"))).alias("mass"), F.max("kept").alias("kept")).where("kept")
    grams = _by_lang_and_order(every.where("kept").select("lang", "k", F.col("gram").alias("key"), "left"))
    contexts = _by_lang_and_order(sums.select("lang", "k", "key", F.col("all").cast("double"), "mass"))
    discard(*levels)
    scaled = lambda p: np.rint(np.log(np.maximum(p, 1e-12)) * SCALE).astype(np.int32)
    for lang in grams:
        below_key, below = np.zeros(1, np.int64), np.full(1, 1 / 256)
        for k, (key, own) in sorted(grams[lang].items()):  # where an order has none, no higher one has
            context, all_, mass = contexts[lang][k]
            rest, at = 1 - mass / all_, np.searchsorted(context, key >> 8)
            lower = below[np.searchsorted(below_key, key & ((1 << 8 * (k - 1)) - 1))]
            below_key, below = key, own / all_[at] + rest[at] * lower
            model.levels.setdefault(lang, {})[k] = (key, scaled(below), context, scaled(rest))
    return model


def _by_lang_and_order(rows: DataFrame) -> dict[str, dict[int, list[np.ndarray]]]:
    """Of rows (lang, k, key, values...): the key and value arrays by language and order,
    sorted by key."""
    table = rows.toArrow().combine_chunks()
    lang = table.column(0).combine_chunks().dictionary_encode() if table.num_rows else pa.array([], pa.string()).dictionary_encode()
    code, k, *columns = (x.to_numpy(zero_copy_only=False) for x in (lang.indices, *table.columns[1:]))
    order = np.lexsort((columns[0], k, code))
    cuts = np.flatnonzero((np.diff(code[order]) != 0) | (np.diff(k[order]) != 0)) + 1
    found: dict[str, dict[int, list[np.ndarray]]] = {}
    for part in np.split(order, cuts):
        if len(part):
            found.setdefault(lang.dictionary[code[part[0]]].as_py(), {})[int(k[part[0]])] = [c[part] for c in columns]
    return found


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words in windows of ``width`` words that occur at least twice."""
    n = len(words)
    if n <= width:
        return 0
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    # Windows are numbered exactly, one word longer at a time; those whose shorter form
    # occurs once drop out, and few are left soon.
    at, code = np.arange(n - width + 1), x[: n - width + 1]
    for k in range(width):
        if k:
            code = code * len(ids) + x[at + k]
        _, code, count = np.unique(code, return_inverse=True, return_counts=True)
        again = count[code] > 1
        at, code = at[again], code[again]
        if not len(at):
            return 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1]) > 0))


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = words_of(text)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "known")
_REST = (("key", T.StringType()), ("gram", T.LongType()), ("n", T.LongType()))


def score(docs: DataFrame, common: dict[str, tuple[np.ndarray, np.ndarray]], order: int, id_col: str, text_col: str, lang_col: str, whole: bool = False) -> DataFrame:
    """Rows of two kinds, told by gram, to be stored before they are used. A text's, with gram
    null: (row, doc_id, lang, base counts, known), the sum of the logarithms of those of its
    n-grams that are in ``common``; with ``whole`` also doc, a struct of all columns of docs. And
    for each different n-gram that a part of a text has besides: (row, key, gram, n)."""
    shared = docs.sparkSession.sparkContext.broadcast(common)
    # The struct holds the text already; without it, only three columns are read.
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns)) if whole else F.struct(F.col(f"`{text_col}`"))
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), doc.alias("doc"), _lang(F.col(lang_col)).alias("key"))
    none = (np.zeros(1, np.int64) - 1, np.zeros(1, np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in batches:
            texts = batch.column(3).field(text_col).to_pylist()
            known = np.zeros(len(texts), np.int64)
            own_columns, row = batch.columns[1 : 3 + whole], batch.column(0).to_numpy()
            for lang, own in _by_language(batch.column(4).to_pylist(), [(x or "").encode("utf-8", "surrogatepass") for x in texts]):
                at = np.array([i for i, _ in own])
                keys, logp = common.get(lang, none)
                for rows, lengths, codes in _blocks([raw for _, raw in own], order):
                    different, place = np.unique(codes, return_inverse=True)
                    there = np.minimum(np.searchsorted(keys, different), len(keys) - 1)
                    hit = keys[there] == different
                    each = np.where(hit, logp[there], 0).astype(np.int64)[place]
                    np.add.at(known, at[rows], np.add.reduceat(each, np.cumsum(lengths) - lengths))
                    rest = np.flatnonzero(~hit[place])
                    pairs, n = np.unique(np.repeat(at[rows], lengths)[rest] * len(different) + place[rest], return_counts=True)
                    for k in range(0, len(pairs), 1 << 16):
                        whose, which = np.divmod(pairs[k : k + (1 << 16)], len(different))
                        empty = [pa.nulls(len(whose), f) for f in [*(c.type for c in own_columns), *[pa.int64()] * len(_COLUMNS)]]
                        yield pa.RecordBatch.from_arrays([pa.array(row[whose]), *empty, pa.repeat(pa.scalar(lang, pa.string()), len(whose)), pa.array(different[which]), pa.array(n[k : k + (1 << 16)])], names=out_schema.names)
            counts = [(*base_counts(text), t) for text, t in zip(texts, known.tolist(), strict=True)]
            numbers = [pa.array(c, pa.int64()) for c in (zip(*counts, strict=True) if counts else [[]] * len(_COLUMNS))]
            empty = [pa.nulls(len(texts), f) for f in (pa.string(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *own_columns, *numbers, *empty], names=out_schema.names)

    own_fields = [T.StructField(f.name, f.dataType) for f in source.schema.fields[: 3 + whole]]  # null in rows of the other kind
    out_schema = T.StructType(own_fields + [T.StructField(c, T.LongType()) for c in _COLUMNS] + [T.StructField(*c) for c in _REST])
    return source.mapInArrow(run, out_schema)


def quality(docs: DataFrame, below: float = 6.0, above: float = 4.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", whole: bool = False, hot: int = HOT) -> DataFrame:
    """Base counts, base_failed, log-perplexity, the bands and kept, for every document;
    with ``whole`` also doc, a struct of all its columns. ``hot`` is a matter of memory alone."""
    grams = log_probabilities(docs.select(_lang(F.col(lang_col)).alias("lang"), F.col(text_col).alias("text")))
    scored = materialize(score(docs, commonest(grams, hot), ORDER, id_col, text_col, lang_col, whole), "scored")
    rest = scored.where(F.col("gram").isNotNull()).select("row", "key", "gram", "n").join(grams.select(F.col("lang").alias("key"), "gram", "logp"), ["key", "gram"])
    rest = rest.groupBy("row").agg(F.sum(F.col("n") * F.col("logp")).alias("rest"))
    texts = scored.where(F.col("gram").isNull())
    n_words, total = F.col("n_words"), F.col("known") + F.coalesce(F.col("rest"), F.lit(0))
    log_ppl = F.expr(f"-total * {STEP} div ({SCALE} * greatest(n_words, 1))")  # by word, in 1 / STEP
    judged = texts.select("row", "doc_id", "lang", *_COLUMNS).join(rest, "row", "left").withColumn("total", total)
    judged = judged.withColumns({"log_ppl": log_ppl, "base_failed": (n_words < 10) | (100 * F.col("n_repeat_words") > 20 * n_words)}).drop("known", "rest", "total")
    judged = materialize(judged, "judged")
    discard(grams, *([] if whole else [scored]))
    release(docs.sparkSession)
    same = F.col("lang").eqNullSafe(F.col("_lang"))
    passed = judged.where(~F.col("base_failed"))
    # A row for each language, from a few thousand different values at most.
    middle = passed.groupBy(F.col("lang").alias("_lang")).agg(F.percentile("log_ppl", F.lit(0.5)).alias("middle"))
    spread = F.sqrt(1 + SHORT / F.greatest(n_words, F.lit(1)))
    off = F.round((F.col("log_ppl") - F.col("middle")) / spread)
    bands = passed.join(middle, same).groupBy("_lang", "middle").agg(F.percentile(off, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    wide = F.col("q")[1] - F.col("q")[0]
    bands = materialize(bands.select("_lang", "middle", (F.col("q")[0] - below * wide).alias("low"), (F.col("q")[1] + above * wide).alias("high")), "bands")
    if bands.count() <= LANGUAGES:  # then the rows of judged stay where they are
        bands = F.broadcast(bands)
    out = judged.join(bands, same, "left").withColumns({"lower_band": F.col("middle") + F.col("low") * spread, "upper_band": F.col("middle") + F.col("high") * spread, "kept": ~F.col("base_failed") & F.coalesce(off.between(F.col("low"), F.col("high")), F.lit(False))})
    if whole:
        out = out.join(texts.select("row", "doc"), "row")
    return out.drop("row", "_lang", "middle", "low", "high")


def keep(docs: DataFrame, below: float = 6.0, above: float = 4.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that pass, with their columns."""
    return quality(docs, below, above, id_col, text_col, lang_col, whole=True).where("kept").select("doc.*")
