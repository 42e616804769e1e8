"""Language identification by Bayesian evidence fusion.

For each page the posterior of a language is the product of

* the text's likelihood: hashed byte trigrams of the visible text, with tables
  learned from a bounded sample of labelled documents; as neighbouring trigrams
  aren't independent, a text counts as ``TRIGRAMS`` of them at most,
* the declared markup language's likelihood given the language,
* the address suffix's likelihood given the language, and
* the host's prior, smoothed towards its domain's and that towards all pages'.

The last three come from grouped aggregation over all pages, of what the texts
alone say; the aggregation starts with partial counts, so a host with a third
of all pages is a few rows by the time it is shuffled.

Defined results: a null page has no text, a null or broken address the empty
host and suffix, a page without a declaration the declaration ""; rows with a
null id are left out; repeated rows count as often as they are there; an empty
table gives an empty result; ties go to the first language by name; without a
labelled document the language is the declared one, or null, and has no
probability.
"""

from __future__ import annotations

import re
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import cut
from .exchange import stream
from .wordbatch import LOWER, U, mix, rows_of, slices, windows

SAMPLE, SAMPLE_CHARS, TABLE, TRIGRAMS, PULL = 2000, 20_000, 1 << 15, 50, 20.0

_HIDES = re.compile(r"<!--|<(script|style)\b", re.I)
_SHOWS = {"": re.compile("-->"), "script": re.compile(r"</script\s*>", re.I), "style": re.compile(r"</style\s*>", re.I)}
_TAG = re.compile(r"<[^>]*>|&[a-z#0-9]+;|\s+", re.I)
_REST = re.compile(r"&[a-z#0-9]+;|\s+", re.I)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b", re.I)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(table places of every trigram, row pointers)."""
    n = np.maximum(np.diff(offsets) - 2, 0)
    h = mix(windows(LOWER[data].astype(U) + U(1), 3))
    keep = np.ones(len(h), dtype=bool)
    for back in (1, 2):  # trigrams over a row's end
        at = offsets[1:-1] - back
        keep[at[(at >= 0) & (at < len(h))]] = False
    return (h[keep] % U(TABLE)).astype(np.int64), np.concatenate([[0], np.cumsum(n)])


def learn(texts: list[str], langs: list[str]) -> tuple[list[str], np.ndarray]:
    """(languages, log probability of each table place in each)."""
    names = sorted(set(langs))
    counts = np.full((len(names), TABLE), 0.1)
    for lo, hi, data, offsets in slices(pa.array(texts, type=pa.string())):
        places, ptr = trigrams(data, offsets)
        for r in range(hi - lo):
            counts[names.index(langs[lo + r])] += np.bincount(places[ptr[r] : ptr[r + 1]], minlength=TABLE)
    return names, np.log(counts / counts.sum(axis=1, keepdims=True))


def visible(html: str) -> str:
    """The text outside comments, scripts, styles and tags.  What is never closed is text; each kind's missing end is looked for once, so time is linear."""
    parts, at, look, missing = [], 0, 0, set()
    while m := _HIDES.search(html, look):
        kind, look = (m[1] or "").lower(), m.end()
        end = None if kind in missing else _SHOWS[kind].search(html, look)
        if end:
            parts.append(html[at : m.start()])
            at = look = end.end()
        else:
            missing.add(kind)
    text = " ".join([*parts, html[at:]])
    last = text.rfind(">") + 1  # no tag ends after it
    return _TAG.sub(" ", text[:last]) + _REST.sub(" ", text[last:])


def address(url: str) -> tuple[str, str, str]:
    """(host, domain, suffix) of an address; empty where there is none."""
    try:
        host = (urlsplit(url).hostname or "").lower().strip(".")
    except ValueError:
        host = ""
    labels = host.split(".")
    return host, ".".join(labels[-2:]), labels[-1]


def _evidence(pages: DataFrame, model, page: str, url: str, html: str) -> DataFrame:
    shared = pages.sparkSession.sparkContext.broadcast(model)  # TABLE numbers a language

    def run(batch: pa.RecordBatch):
        names, table = shared.value
        urls, declared, texts = [], [], []
        for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            m = _LANG.search(h or "")
            declared.append(m[1].lower() if m else "")
            urls.append(address(u or ""))
            texts.append(visible(h or ""))
        for lo, hi, data, offsets in slices(pa.array(texts, type=pa.string())):
            places, ptr = trigrams(data, offsets)
            sums = np.zeros((len(names), len(places) + 1))
            np.cumsum(table[:, places], axis=1, out=sums[:, 1:])
            n = np.diff(ptr)
            score = (sums[:, ptr[1:]] - sums[:, ptr[:-1]]).T * (np.minimum(n, TRIGRAMS) / np.maximum(n, 1))[:, None]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows_of(batch, "page_id", lo, hi)), *(pa.array([u[i] for u in urls[lo:hi]], type=pa.string()) for i in range(3)), pa.array(declared[lo:hi], type=pa.string()), pa.array(score.argmax(axis=1).astype(np.int32)), pa.array(score.tolist(), type=pa.list_(pa.float64()))],
                names=["page_id", "host", "domain", "suffix", "declared", "told", "score"],
            )

    source = pages.where(F.col(page).isNotNull()).select(F.col(page).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return source.mapInArrow(stream(run), "page_id long, host string, domain string, suffix string, declared string, told int, score array<double>")


def identify(pages: DataFrame, labelled: DataFrame, *, page: str = "page_id", url: str = "url", html: str = "html", text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """``page_id, lang, probability, text_lang, declared, host`` of every page."""
    near = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) <= SAMPLE_CHARS)).select(F.col(key).cast("long").alias("k"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    ids = near.select("k").orderBy(F.xxhash64("k"), "k").limit(SAMPLE).distinct()
    rows = near.join(F.broadcast(ids), "k").orderBy("k", "text", "lang").limit(2 * SAMPLE).collect()
    if not rows:
        seen = _evidence(pages, ([""], np.zeros((1, TABLE))), page, url, html)
        return seen.select("page_id", F.nullif("declared", F.lit("")).alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"), "declared", "host")
    names, table = learn([r.text for r in rows], [r.lang for r in rows])
    seen = cut(_evidence(pages, (names, table), page, url, html))
    counted = seen.groupBy("host", "domain", "suffix", "declared", "told").agg(F.count("*").alias("m"))
    each = range(len(names))
    vector = F.array(*[F.sum(F.when(F.col("told") == i, F.col("m")).otherwise(0)).cast("double") for i in each])
    total = F.aggregate("c", F.lit(0.0), lambda s, x: s + x)
    toward = lambda above: F.zip_with(F.col("c"), above, lambda x, p: (x + F.lit(PULL) * p) / (total + F.lit(PULL)))
    n = [float(x or 0) for x in counted.agg(vector.alias("c")).first()["c"]]  # a number a language
    c_all, p_all = F.array(*[F.lit(x) for x in n]), F.array(*[F.lit((x + 1) / (sum(n) + len(names))) for x in n])
    domain = counted.groupBy("domain").agg(vector.alias("c")).select("domain", toward(p_all).alias("p_domain"))
    host = counted.groupBy("host", "domain", "suffix").agg(vector.alias("c")).join(domain, "domain").select("host", "suffix", F.transform(toward(F.col("p_domain")), lambda p: F.log(p)).alias("prior"))
    # likelihood of a suffix or declaration given the language, smoothed by its share of all pages
    given = lambda by, name: counted.groupBy(by).agg(vector.alias("c")).select(by, F.zip_with("c", c_all, lambda x, a: F.log((x + (total + 1) / (sum(n) + 1)) / (a + 1))).alias(name))
    host = host.join(given("suffix", "by_suffix"), "suffix").select("host", F.zip_with("prior", "by_suffix", lambda x, y: x + y).alias("by_host"))
    joined = seen.join(host, "host").join(given("declared", "by_declared"), "declared")
    log = F.transform(F.arrays_zip("score", "by_host", "by_declared"), lambda z: z["score"] + z["by_host"] + z["by_declared"])
    joined = joined.select("page_id", "host", "declared", "told", log.alias("log")).withColumn("top", F.array_max("log"))
    labels = F.array(*[F.lit(x) for x in names])
    best = F.array_position("log", F.col("top")).cast("int")
    weight = F.aggregate("log", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    return joined.select("page_id", F.element_at(labels, best).alias("lang"), (1 / weight).alias("probability"), F.element_at(labels, F.col("told") + 1).alias("text_lang"), "declared", "host")


def op5_language(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))
