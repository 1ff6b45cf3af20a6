"""Language identification by Bayesian fusion of evidence.

For each page four kinds of evidence meet: the likelihood of its text under a trigram model of each
language, that of the language its markup declares, that of its address suffix, and the prior of its host.
All but the first come from grouped sums of what the texts of the other pages say: how often pages of a
language declare this language or have this suffix, and a host's shares, smoothed level by level (a host
leans on its domain, a domain on all pages). A page's own text is taken out of every sum that judges it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.llm.shared import cut
from cardloom.llm.url_filter import url_host

HASH_BITS = 16
#: Neighbouring trigrams are not independent: n of them weigh as EVIDENCE log(1 + n / EVIDENCE), which grows with every n, ever more slowly.
EVIDENCE = 100.0
#: Pages that a level's prior weighs at the level below.
STRENGTH = 5.0
WINDOW = 1 << 20

#: Elements whose content is not the page's text.
_SKIPPED = frozenset({"script", "style", "noscript", "template", "nav", "aside", "footer"})
_TAG = re.compile(r"<([/!]?)([a-zA-Z][a-zA-Z0-9]*)[^<>]*>")
DECLARED = r"(?i)<html\b[^<>]*\blang\s*=\s*[\"']?([a-z]{2,3})\b"


def page_text(markup: str) -> str:
    """The text of a page: no comments, no tags, nothing from skipped elements; entities resolved. One pass over the markup."""
    parts, at = [], 0
    while (start := markup.find("<!--", at)) >= 0:
        parts.append(markup[at:start])
        end = markup.find("-->", start + 4)
        at = len(markup) if end < 0 else end + 3
    markup = "".join([*parts, markup[at:]])
    out, at, skipped = [], 0, ""
    for tag in _TAG.finditer(markup):
        if not skipped:
            out.append(markup[at : tag.start()])
        name = tag[2].lower()
        if skipped:
            skipped = "" if tag[1] and name == skipped else skipped
        elif not tag[1] and name in _SKIPPED:
            skipped = name
        at = tag.end()
    if not skipped:
        out.append(markup[at:])
    return html.unescape(" ".join(out))


def trigram_ids(text: str) -> Iterator[np.ndarray]:
    """Hashed trigrams of the lower-cased text whose runs of other characters than letters are one space, window by window."""
    flat = f" {' '.join(_LETTERS.findall(text.lower()))} "
    for at in range(0, max(1, len(flat) - 2), WINDOW):
        p = np.frombuffer(flat[at : at + WINDOW + 2].encode("utf-32-le", "replace"), np.uint32)
        if len(p) > 2:
            h = (p[:-2] * np.uint32(0x9E3779B1) + p[1:-1]) * np.uint32(0x85EBCA6B) + p[2:]
            yield ((h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - HASH_BITS)).astype(np.int64)


_LETTERS = re.compile(r"[^\W\d_]+")


def trigram_counts(docs: DataFrame) -> DataFrame:
    """``lang, id, n`` over all ``docs (text, lang, ...)``; rows without a language or a text are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
                counts = seen.setdefault(lang.as_py(), np.zeros(1 << HASH_BITS, np.int64))
                for ids in trigram_ids(text.as_py()):
                    counts += np.bincount(ids, minlength=1 << HASH_BITS)
        for lang, counts in seen.items():
            ids = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids), pa.string()), pa.array(ids), pa.array(counts[ids])], ["lang", "id", "n"])

    told = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    return told.mapInArrow(run, "lang string, id long, n long").groupBy("lang", "id").agg(F.sum("n").alias("n"))


def trigram_model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and for each the log probability of every hashed trigram: 65,536 numbers a language, however many documents."""
    counts = trigram_counts(docs).toArrow().to_pandas()
    langs = sorted(counts["lang"].unique())
    table = np.full((len(langs), 1 << HASH_BITS), 0.5)
    for k, lang in enumerate(langs):
        mine = counts[counts["lang"] == lang]
        table[k, mine["id"].to_numpy(np.int64)] += mine["n"].to_numpy(np.float64)
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def text_evidence(pages: DataFrame, model: np.ndarray) -> DataFrame:
    """Adds ``text_log``, the weighed log likelihood of the page's text in each language, in place of ``html``."""
    names = [c for c in pages.columns if c != "html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = []
            for markup in batch.column("html"):
                total, n = np.zeros(len(model)), 0
                for ids in trigram_ids(page_text(markup.as_py() or "")):
                    total += model[:, ids].sum(axis=1, dtype=np.float64)
                    n += len(ids)
                logs.append((total * (EVIDENCE * np.log1p(n / EVIDENCE) / max(n, 1))).tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(logs, pa.list_(pa.float64()))], [*names, "text_log"])

    kinds = ", ".join(f"{c} {dict(pages.dtypes)[c]}" for c in names)
    return pages.mapInArrow(run, f"{kinds}, text_log array<double>")


def site_of(url: Column) -> Column:
    """The host of a URL as a name: without user part, port and a dot at the end; empty where there is none."""
    return F.regexp_replace(F.regexp_replace(url_host(url), r"(?s)^.*@", ""), r"\.?(?::[0-9]*)?$", "")


def is_address(site: Column) -> Column:
    """True for numeric addresses, which have neither suffix nor domain."""
    return site.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") | site.startswith("[")


def domain_of(site: Column) -> Column:
    """The last two labels, or three where the second one from the end is a short one before a country's (co.uk); an address is its own."""
    labels = F.when(site.rlike(r"\.[^.]{1,3}\.[a-z]{2}$"), F.substring_index(site, ".", -3)).otherwise(F.substring_index(site, ".", -2))
    return F.when(is_address(site), site).otherwise(labels)


def suffix_of(site: Column) -> Column:
    """The last label; none for an address."""
    return F.when(is_address(site), "").otherwise(F.substring_index(site, ".", -1))


def softmax(logs: Column) -> Column:
    """An array of log weights, as probabilities."""
    top = F.array_max(logs)
    parts = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(parts, lambda x: x / total)


def _sums(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """One array of sums over ``share`` for each key: plain sums of columns, so partial sums meet hot keys first."""
    summed = rows.groupBy(*keys).agg(*[F.sum(F.col("share")[i]).alias(f"s{i}") for i in range(n)])
    return summed.select(*keys, F.array(*[F.col(f"s{i}") for i in range(n)]).alias("share"))


def _total(share: Column) -> Column:
    return F.aggregate(share, F.lit(0.0), lambda a, x: a + x)


def _without(share: Column, own: Column) -> Column:
    """Sums without a page's own shares."""
    return F.zip_with(share, own, lambda s, o: F.greatest(s - o, F.lit(0.0)))


def smoothed(share: Column, above: Column) -> Column:
    """Shares of a level, leaning on the level above."""
    return F.zip_with(share, above, lambda s, a: (s + STRENGTH * a) / (_total(share) + STRENGTH))


def log_likelihood(share: Column, everywhere: Column, kinds: int) -> Column:
    """For each language, the log probability that its pages are of a kind with these sums, where ``kinds`` of them occur."""
    return F.zip_with(share, everywhere, lambda s, e: F.log((s + 1.0) / (e + kinds)))


def identify_languages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Language of every row of ``pages (page_id, url, html, ...)``, with models from all of ``docs (text, lang, ...)``.

    Returns ``page_id, lang, probability, text_lang, declared``; ``text_lang`` is what the text alone says.

    * A page's own text is taken out of the sums of its host, domain, suffix and declared language before these judge it.
    * A host counts without user part and port; a numeric address has no suffix and is its own domain.
    * Without text, declared language or host (null or empty columns) the other evidence decides; ties go to the first language in order.
    * Languages are those of ``docs``; without any, lang and probability are null. Pages of other languages get the nearest.
    * Repeated rows all stay. No pages give no rows. Other columns are ignored.
    """
    langs, model = trigram_model(docs)
    declared = F.nullif(F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), DECLARED, 1)), F.lit(""))
    told = pages.select("page_id", site_of(F.col("url")).alias("host"), declared.alias("declared"), "html")
    if not langs:
        nothing = F.lit(None).cast("string")
        return told.select("page_id", nothing.alias("lang"), F.lit(None).cast("double").alias("probability"), nothing.alias("text_lang"), "declared")
    n = len(langs)
    rows = cut(text_evidence(told, model)).withColumn("share", softmax(F.col("text_log"))).withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))

    host = cut(_sums(rows, ["suffix", "domain", "host"], n))
    domain = _sums(host, ["suffix", "domain"], n)
    suffix = cut(_sums(domain, ["suffix"], n))
    # At most 26**2 + 26**3 declared languages match the pattern.
    said = cut(_sums(rows.filter("declared IS NOT NULL"), ["declared"], n))

    def all_of(sums: DataFrame, key: str) -> tuple[Column, int]:
        """Sums over every kind, and the number of kinds."""
        found = sums.agg(*[F.sum(F.col("share")[i]) for i in range(n)], F.count(key)).first()
        return F.array(*[F.lit(x or 0.0) for x in found[:n]]), found[n]

    everywhere, _ = all_of(suffix, "suffix")
    named, suffixes = all_of(suffix.filter("suffix <> ''"), "suffix")
    declaring, kinds = all_of(said, "declared")
    of_domain = domain.withColumnRenamed("share", "domain_share").join(suffix.withColumnRenamed("share", "suffix_share"), "suffix").drop("suffix")
    of_host = cut(host.select("host", "domain", F.col("share").alias("host_share")).join(of_domain, "domain").drop("domain"))

    told_of = said.withColumnRenamed("share", "said_share")
    judged = rows.drop("domain").join(of_host, "host").join(F.broadcast(told_of), "declared", "left")
    own = F.col("share")
    base = F.transform(_without(everywhere, own), lambda x: x + 1.0)
    base = F.transform(base, lambda x: x / _total(base))
    prior = smoothed(_without(F.col("host_share"), own), smoothed(_without(F.col("domain_share"), own), base))
    silent = F.array(*[F.lit(0.0)] * n)
    by_suffix = F.when(F.col("suffix") != "", log_likelihood(_without(F.col("suffix_share"), own), _without(named, own), suffixes)).otherwise(silent)
    by_markup = F.coalesce(log_likelihood(_without(F.col("said_share"), own), _without(declaring, own), kinds), silent)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    told_prior = judged.select("page_id", "declared", "share", "text_log", prior.alias("prior"), by_suffix.alias("by_suffix"), by_markup.alias("by_markup"))
    fused = add(add(F.col("text_log"), F.transform("prior", lambda p: F.log(p))), add(F.col("by_suffix"), F.col("by_markup")))
    names = F.array(*[F.lit(x) for x in langs])
    found = told_prior.select("page_id", "declared", softmax(fused).alias("p"), "share")
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    return found.select("page_id", best(F.col("p")).alias("lang"), F.array_max("p").alias("probability"), best(F.col("share")).alias("text_lang"), "declared")
