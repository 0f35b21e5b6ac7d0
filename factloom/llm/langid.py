"""Language identification of pages by Bayesian evidence fusion.

The log-odds of each language add up from: the visible text (byte trigrams, multinomial with add-``ALPHA``
counts, tempered by ``TEMPER`` as neighbouring trigrams aren't independent), the language declared in the
markup, the language-like first segment of the address, and a prior of the host. What a declaration or a segment says
about each language is learned from all pages by grouped sums of the text's posteriors. The host's prior
starts from all pages and is smoothed down the hierarchy address suffix, registered domain, host, each level
with ``KAPPA`` pseudo-pages of its parent; a page's own posterior is taken out of every sum that it meets.

The trigram model is fitted on a sample of about ``MOST_ROWS`` documents of each language that has a document with a
text; their trigrams are counted in tasks and summed by a shuffle, so the driver gets the model's counts only. The model
grows with the number of languages, which has no bound. All sums cover all pages and are aggregated map-side. Pages of a host with many are salted where
they meet their host's prior, over as many keys as it has ``PAGES_A_SALT``, so a host with a third of all pages isn't one task.

Defined results: a page without text, declaration and address gets the prior of all pages; null addresses
share the host ''; without documents of known language every result is null; repeated rows count as pages of
their own; extra columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import html as markup
from factloom.llm import textops as ops

BUCKET_BITS, ALPHA, TEMPER, KAPPA, SMOOTH = 15, 0.1, 0.1, 8.0, 1.0
MOST_ROWS = 400
#: Pages of a host for each of which its sums get one copy more; hosts that may have several copies.
PAGES_A_SALT, MOST_HOT = 256, 4096
#: Log-probabilities that are looked up at once.
AT_ONCE = 1 << 22


def _trigrams(data: np.ndarray) -> np.ndarray:
    """Hashed trigrams of lower-cased bytes, with runs of non-letters as one space."""
    low = ops.LOWER[data]
    letter = ops.WORD_ALNUM[low].astype(bool) & ~((low >= 0x30) & (low <= 0x39))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    low = np.where(letter, low, 0x20)[keep].astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, np.int64)
    key = low[:-2] | low[1:-1] << 8 | low[2:] << 16
    return ((key * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def train(names: list[str], counts: pa.Table) -> tuple[list[str], np.ndarray]:
    """Languages, and for each bucket the log-probability of its trigrams in each language."""
    table = np.empty((1 << BUCKET_BITS, len(names)), np.float32)
    at = np.searchsorted(counts.column("at").to_numpy(), np.arange(len(names) + 1))
    bucket, n = (counts.column(c).to_numpy() for c in ("bucket", "n"))
    for i in range(len(names)):
        mine = np.full(1 << BUCKET_BITS, ALPHA)
        mine[bucket[at[i] : at[i + 1]]] += n[at[i] : at[i + 1]]
        table[:, i] = np.log(mine / mine.sum())
    return names, table


def sample(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, most: int = MOST_ROWS) -> tuple[list[str], pa.Table]:
    """The languages of all documents with a text, and (at, bucket, n): trigram counts by place of the language.

    Counted over about ``most`` documents of each language, taken by the hash of their id and text; at least the one of least hash.
    """
    ops.bounded(docs.sparkSession)
    known = docs.where(F.col(lang_col).isNotNull() & (F.octet_length(text_col) > 0))
    known = known.select(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"), F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 20)).alias("_hash"))
    stats = known.groupBy("_lang").agg(F.count("*").alias("n"), F.min("_hash").alias("least")).toArrow().to_pylist()
    names = sorted(r["_lang"] for r in stats)
    if not names:
        return names, pa.table({c: pa.array([], pa.int64()) for c in ("at", "bucket", "n")})
    place = {name: i for i, name in enumerate(names)}
    rows = [(r["_lang"], place[r["_lang"]], max(int(min(1.0, most / r["n"]) * (1 << 20)), r["least"] + 1)) for r in stats]
    chosen = known.join(F.broadcast(docs.sparkSession.createDataFrame(rows, "_lang string, _at long, _under long")), "_lang").where("_hash < _under").select("_text", "_at")

    def count(batches):
        held: dict[int, np.ndarray] = {}
        for part in ops.text_slices(batches, "_text"):
            for text, at in zip(part.column("_text").to_pylist(), part.column("_at").to_pylist(), strict=True):
                own = np.bincount(_trigrams(np.frombuffer(text.encode(), np.uint8)), minlength=1 << BUCKET_BITS)
                held[at] = held[at] + own if at in held else own
                if len(held) > 256:
                    yield from given(held)
        yield from given(held)

    def given(held):
        while held:
            at, n = held.popitem()
            bucket = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), at)), pa.array(bucket), pa.array(n[bucket])], names=["at", "bucket", "n"])

    counts = chosen.mapInArrow(count, "at bigint, bucket bigint, n bigint").groupBy("at", "bucket").agg(F.sum("n").alias("n"))
    return names, counts.toArrow().sort_by("at")


def evidence(pages: DataFrame, model: tuple[list[str], np.ndarray], *, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, host, domain, suffix, segment, declared, text array<double>, own array<double>): the text's tempered log-likelihoods and posteriors."""
    spark = pages.sparkSession
    ops.bounded(spark)
    sent = spark.sparkContext.broadcast(model)
    host = F.lower(F.coalesce(F.regexp_extract(url_col, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))
    with_address = pages.select(id_col, html_col, host.alias("host"), F.nullif(F.lower(F.regexp_extract(url_col, r"^[^:]*://[^/?#]*/([a-zA-Z]{2,3})(?:[/?#_-]|$)", 1)), F.lit("")).alias("segment"))

    def make():
        names, table = sent.value
        step = max(1, AT_ONCE // max(1, len(names)))

        def work(batch: pa.RecordBatch) -> dict[str, object]:
            declared, text = [], []
            for h in batch.column(html_col).to_pylist():
                declared.append(markup.declared_language(h))
                at = _trigrams(np.frombuffer(markup.render(h).encode(), np.uint8))
                logs = np.zeros(len(names))
                for i in range(0, len(at), step):
                    logs += table[at[i : i + step]].sum(axis=0, dtype=np.float64)
                text.append(TEMPER * logs)
            return {"declared": declared, "text": [t.tolist() for t in text], "own": [_softmax(t).tolist() for t in text]}

        return work

    found = ops.map_text(with_address, html_col, make, [("declared", "string"), ("text", "array<double>"), ("own", "array<double>")], [id_col, "host", "segment"])
    return found.withColumns({"domain": F.substring_index("host", ".", -2), "suffix": F.substring_index("host", ".", -1)})


def _softmax(logs: np.ndarray) -> np.ndarray:
    e = np.exp(logs - logs.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _sums(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """For each key the summed posteriors, summed language by language and map-side combined; plans don't grow with the languages."""
    each = df.select(*keys, F.posexplode("own").alias("_at", "_own")).groupBy(*keys, "_at").agg(F.sum("_own").alias("_own"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_own"))), lambda x: x["_own"]).alias(name))


def _smoothed(counts: np.ndarray, parent: np.ndarray | float) -> np.ndarray:
    return (counts + KAPPA * parent) / (counts.sum(axis=1, keepdims=True) + KAPPA)


def fuse(found: DataFrame, names: list[str], id_col: str) -> DataFrame:
    """(id, lang, confidence, text_lang, declared, segment, host) from the evidence of all pages."""
    n = len(names)
    own = ops.cut(found)
    all_ = _sums(own, [], "all_sum")
    hosts = ops.cut(_sums(own, ["host", "domain", "suffix"], "host_sum"))
    part = lambda key, name: hosts.withColumn("own", F.col("host_sum")).transform(lambda d: _sums(d, [key], name))
    # One row for each host, with its domain's, suffix's and everything's sums beside it; a copy for each salt of a host with many pages.
    least = max(PAGES_A_SALT, own.count() // MOST_HOT)
    pages_of = F.aggregate("host_sum", F.lit(0.0), lambda a, x: a + x)
    tree = hosts.join(part("domain", "domain_sum"), "domain").join(part("suffix", "suffix_sum"), "suffix").crossJoin(F.broadcast(all_))
    tree = tree.withColumn("salts", F.greatest(F.lit(1), F.ceil(pages_of / least)).cast("int"))
    tree = tree.select("host", "host_sum", "domain_sum", "suffix_sum", "all_sum", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    # At most MOST_HOT hosts have more than one copy.
    hot = F.broadcast(hosts.where(pages_of > least).select("host", F.ceil(pages_of / least).cast("int").alias("salts")))
    # Primary tags of two or three letters: at most 26 ** 2 + 26 ** 3 rows each.
    tags = {k: F.broadcast(_sums(own.where(F.col(k).isNotNull()), [k], f"{k}_sum")) for k in ("declared", "segment")}
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("salts", F.lit(1))).cast("int")
    salted = own.join(hot, "host", "left").withColumn("salt", spread).drop("salts")
    joined = salted.join(tree, ["host", "salt"]).join(tags["declared"], "declared", "left").join(tags["segment"], "segment", "left")
    levels = ["all_sum", "suffix_sum", "domain_sum", "host_sum"]
    rows = joined.select(id_col, "declared", "segment", "host", "text", "own", *levels, "declared_sum", "segment_sum")
    schema = T.StructType([rows.schema[id_col], *T._parse_datatype_string("lang string, confidence double, text_lang string, declared string, segment string, host string")])

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue

            def table(name):
                """The rows' arrays, zeros where there is none; and where there is one."""
                column = batch.column(name)  # noqa: B023
                there, out = column.is_valid().to_numpy(zero_copy_only=False), np.zeros((len(column), n))
                out[there] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                return out, there

            (logs, _), (o, _) = table("text"), table("own")
            less = {c: np.maximum(table(c)[0] - o, 0.0) for c in levels}
            prior = 1.0 / n
            for c in levels:
                prior = _smoothed(less[c], prior)
            logs = logs + np.log(prior)
            for c in ("declared_sum", "segment_sum"):
                # log P(tag | language), up to what all languages share; nothing where there is no tag.
                seen, there = table(c)
                logs += np.where(there[:, None], np.log((np.maximum(seen - o, 0.0) + SMOOTH / n) / (less["all_sum"] + SMOOTH)), 0.0)
            p = _softmax(logs)
            said = lambda x: pa.array([names[i] for i in x.argmax(axis=1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), said(p), pa.array(p.max(axis=1)), said(o), *(batch.column(c) for c in ("declared", "segment", "host"))], names=schema.fieldNames())

    return rows.mapInArrow(work, schema)


def identify(pages: DataFrame, docs: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", doc_id: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each page: id, lang, confidence, text_lang, declared, segment, host."""
    model = train(*sample(docs, id_col=doc_id, text_col=text_col, lang_col=lang_col))
    if not model[0]:
        none = {"lang": "string", "confidence": "double", "text_lang": "string", "declared": "string", "segment": "string", "host": "string"}
        return pages.select(id_col, *(F.lit(None).cast(t).alias(n) for n, t in none.items()))
    return fuse(evidence(pages, model, id_col=id_col, url_col=url_col, html_col=html_col), model[0], id_col)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page, learned from documents."""
    return identify(ops.read(spark, sf_dir, "pages"), ops.read(spark, sf_dir, "documents"))


def brute_force(rows: list[dict], names: list[str]) -> list[tuple[str, float]]:
    """The fusion in plain numpy, page by page, for tests; rows have host, declared, segment, text."""
    own = [np.exp(np.array(r["text"]) - max(r["text"])) for r in rows]
    own = [p / p.sum() for p in own]
    out = []
    for i, r in enumerate(rows):
        others = [(q, own[j]) for j, q in enumerate(rows) if j != i]
        total = lambda key: sum((p for q, p in others if key(q)), np.zeros(len(names)))
        level = lambda k: (lambda q: q["host"].split(".")[-k:] == r["host"].split(".")[-k:])
        prior = np.full(len(names), 1 / len(names))
        for counts in (total(lambda q: True), total(level(1)), total(level(2)), total(lambda q: q["host"] == r["host"])):
            prior = (counts + KAPPA * prior) / (counts.sum() + KAPPA)
        logs = np.array(r["text"]) + np.log(prior)
        for tag in ("declared", "segment"):
            if r[tag] is not None:
                logs += np.log((total(lambda q: q[tag] == r[tag]) + SMOOTH / len(names)) / (total(lambda q: True) + SMOOTH))
        p = np.exp(logs - logs.max())
        p /= p.sum()
        out.append((names[int(p.argmax())], float(p.max())))
    return out
