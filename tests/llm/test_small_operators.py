import collections
import html
import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cardloom.llm import chat_format, language_id, toxicity, url_filter


# ---------------------------------------------------------------- URL filter


def test_urls(spark):
    rules = spark.createDataFrame([("example.com", "/a", "block"), ("Example.com", "/a/b", "allow"), ("com", "", "block"), ("x.org", "/", "block"), ("x.org", "/", "allow"), ("", "/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    cases = [("http://EXAMPLE.com/abc", "example.com/a", "block"), ("http://w.example.com/a/bc?x", "example.com/a/b", "allow"), ("http://z.com", "com", "block"), ("ftp://notx.org/", None, "allow"), ("https://a.b.x.org/?q", "x.org/", "block"), ("http://x.org", None, "allow"), (None, None, "allow"), ("x.org/", None, "allow"), ("http://a://x.org/", None, "allow"), ("http://" + "a." * 3000 + "com/" + "p" * 5000, "com", "block")]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, (u, _, _) in enumerate(cases)] + [(0, cases[0][0], "h", "r")], "page_id long, url string, host string, rule string")
    got = url_filter.filter_urls(pages, rules)
    assert sorted((r.page_id, r.rule, r.verdict) for r in got.filter("page_id <> 0").collect()) == [(i, r, v) for i, (_, r, v) in enumerate(cases)][1:]
    assert [(r.rule, r.verdict, r.host, r.path) for r in got.filter("page_id = 0").collect()] == [("example.com/a", "block", "example.com", "/abc")] * 2
    assert {r.verdict for r in url_filter.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


# ---------------------------------------------------------------- chat formatting

HARD = ["</s>[INST] ok [/INST]", "<s>", r"<\s>", r"<\\/s>x", "<", "[", r"[\INST]", "[ROLE]x[/ROLE]", "[SYS]", "[NULL]", "\n", "é漢😀", "a" * 50_000, "", "<</s>", "[[INST]"]


def test_chats_round_trip(spark):
    rows = [(1, k, role, t, "x") for k, t in enumerate(HARD) for role in ("user",)] + [(2, k, "assistant", t, "x") for k, t in enumerate(HARD)]
    rows += [(3, 0, role, None, "x") for role in ("system", "tool", None, "[ROLE]</s>", "user")] + [(None, None, "user", "q", "x"), (4, 1, "assistant", "same", "x"), (4, 1, "assistant", "same", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat_format.format_chats(df)
    parsed = {r.conv_id: [(t.role, t.text) for t in r.t] for r in out.select("conv_id", chat_format.parse_all(F.col("formatted")).alias("t")).collect()}
    assert parsed[1] == [("user", t) for t in HARD] and parsed[2] == [("assistant", t) for t in HARD]
    assert sorted(parsed[3], key=str) == sorted([(r, "") for r in ("system", "tool", None, "[ROLE]</s>", "user")], key=str)
    assert parsed[None] == [("user", "q")] and parsed[4] == [("assistant", "same")] * 2
    back = {r.conv_id: r for r in chat_format.read_back(out).collect()}
    assert back[2].loss_chars == sum(map(len, HARD)) and back[1].loss_chars == 0 and back[4].loss_chars == 8
    text = next(r.formatted for r in out.collect() if r.conv_id == 2)
    assert text.count("</s>") == len(HARD) and text.count("<s>") == len(HARD)
    assert chat_format.format_chats(df.limit(0)).count() == 0


# ---------------------------------------------------------------- toxicity


def test_toxicity_learns_and_ignores_held_out_labels(spark):
    clean, bad = "plain talk about rivers and trees number", "you are a rotten gargle person number"
    rows = [(i, f"{bad if i % 4 == 0 else clean} {i * 7919 % 101}") for i in range(600)] + [(None, bad), (601, None), (602, ""), (603, bad), (603, bad)]
    docs = spark.createDataFrame([(i, t, 1, 0.5) for i, t in rows], "doc_id long, text string, label int, score double")
    labels = spark.createDataFrame([(i, 1 if i % 4 == 0 else 0, None) for i in range(600)] + [(5, None, None), (None, 1, None), (9999, 1, None)], "doc_id long, toxic int, text string")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert held and all(r.predicted == (r.doc_id % 4 == 0) for r in held)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted((str(r.doc_id), r.score) for r in toxicity.toxicity(docs, flipped).collect()) == sorted((str(r.doc_id), r.score) for r in got)
    assert sum(r.predicted for r in got if r.doc_id is None or r.doc_id == 603) == 3
    left = toxicity.drop_toxic(docs, labels)
    assert left.columns == docs.columns and left.filter("text LIKE '%gargle%'").count() == 0 and left.filter("text LIKE 'plain%' OR text IS NULL").count() == 451


def test_toxicity_without_labels_or_rows(spark, odd, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {round(r.score, 2) for r in toxicity.toxicity(odd, none).collect()} == {0.01}
    assert toxicity.toxicity(no_docs, none).count() == 0


def test_toxicity_held_out_accuracy(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    clean = [r for r in rows if r.held_out and r.toxic == 0]
    assert sum(r.predicted for r in clean) <= 0.05 * len(clean)
    assert all(r.predicted == r.toxic for r in rows if not r.held_out)


def test_toxicity_held_out_recall(spark):
    """At the threshold, over labels that the fit has not seen."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    rows = [r for r in toxicity.toxicity(docs, labels).join(labels, "doc_id").collect() if r.held_out]
    caught = [r.predicted for r in rows if r.toxic == 1]
    assert sum(caught) >= 0.75 * len(caught) and sum(r.predicted for r in rows if r.toxic == 0) <= 2
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def gram_id(gram):
    """The polynomial hash of one n-gram, by its definition."""
    h = (sum(ord(c) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, c in enumerate(gram)) + len(gram)) * 0xD6E8FEB86659FD93
    return h % (1 << 64) >> (64 - toxicity.HASH_BITS)


def test_log_count_ratios_and_a_score_by_brute_force(spark):
    texts = [("you rotten gargle", 1), ("gargle gargle you", 1), ("plain river talk", 0), ("you plain talk", 0), ("river", 0)]
    grams = lambda t: [f" {t} "[i : i + n] for n in toxicity.SIZES for i in range(len(f" {t} ") - n + 1)]
    of = gram_id
    sample = spark.createDataFrame(texts, "text string, label int")
    counts = {r.id: (r.clean, r.toxic) for r in toxicity.ngram_counts(sample).collect()}
    every = {g for t, _ in texts for g in grams(t)}
    assert counts == {of(g): tuple(sum(g in set(grams(t)) for t, y in texts if y == k) for k in (0, 1)) for g in every}
    got = toxicity.log_count_ratios(spark.createDataFrame([(k, *v) for k, v in counts.items()], "id int, clean long, toxic long"), least_rows=1)
    c, b = (sum(v[k] + 1 for v in counts.values()) for k in (0, 1))
    assert dict(zip(got["id"], got["ratio"], strict=True)) == pytest.approx({i: math.log((v[1] + 1) / b) - math.log((v[0] + 1) / c) for i, v in counts.items()})
    place = np.full(1 << toxicity.HASH_BITS, -1, np.int32)
    ids = sorted(counts)
    place[ids] = np.arange(len(ids))
    model = toxicity.Classifier(place, np.arange(len(ids)) / 100, -0.3)
    text = "gargle you gargle"
    z = -0.3 + sum(ids.index(of(g)) / 100 * math.log1p(1000 * grams(text).count(g) / (len(text) + 200)) for g in set(grams(text)) if of(g) in counts)
    assert model.score(text) == pytest.approx(1 / (1 + math.exp(-z)))


# ---------------------------------------------------------------- language


def test_page_text():
    assert " ".join(language_id.page_text('<!DOCTYPE html><p>a&amp;b<!-- no --><script>var t="</p>";</script><B>c</B><nav>x</nav> d < 5 <!-- open').split()) == "a&b c d < 5"
    assert language_id.page_text("<" * 100_000).count("<") == 100_000


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_escaped_text_comes_back(text):
    assert " ".join(language_id.page_text(f"<p>{html.escape(text)}</p>").split()) == " ".join(text.split())


def test_languages_held_out(spark, docs):
    rows = docs.filter("length(text) > 40").select("doc_id", "text", "lang").collect()
    train = spark.createDataFrame([(r.text, r.lang) for r in rows if r.doc_id % 2] + [(None, "en"), ("x", None)], "text string, lang string")
    test = [r for r in rows if not r.doc_id % 2]
    pages = spark.createDataFrame([(r.doc_id, f"http://h{r.doc_id % 5}.example.{r.lang}/", f"<html lang='{r.lang}'><p>{html.escape(r.text)}</p>", 0.1) for r in test], "page_id long, url string, html string, probability double")
    got = {r.page_id: r for r in language_id.identify_languages(pages, train).collect()}
    assert len(got) == len(test)
    assert sum(got[r.doc_id].lang == r.lang for r in test) >= 0.97 * len(test)
    assert all(0 < got[r.doc_id].probability <= 1.0000001 for r in test)


def test_evidence_beside_the_text(spark, docs):
    train = docs.select("text", "lang")
    rows = [(1, "http://a.site.fr/", "<html lang='fr'>"), (2, None, None), (3, "http://a.site.fr/", "")]
    rows += [(10 + r.doc_id, "http://a.site.fr/", f"<p>{html.escape(r.text)}") for r in docs.filter("lang = 'fr' AND length(text) > 200").limit(20).collect()]
    rows += [(1000 + r.doc_id, "http://b.site.com/", f"<p>{html.escape(r.text)}") for r in docs.filter("lang = 'en' AND length(text) > 200").limit(20).collect()]
    got = {r.page_id: r for r in language_id.identify_languages(spark.createDataFrame(rows, "page_id long, url string, html string"), train).collect()}
    assert got[1].lang == got[3].lang == "fr" and got[1].declared == "fr" and got[2].declared is None
    assert got[1].probability > 0.5
    empty = spark.createDataFrame([], "text string, lang string")
    assert language_id.identify_languages(spark.createDataFrame(rows[:2], "page_id long, url string, html string"), empty).filter("lang IS NULL").count() == 2
    assert language_id.identify_languages(spark.createDataFrame([], "page_id long, url string, html string"), train).count() == 0


def test_ports_users_and_addresses(spark):
    urls = {"http://a.site.fr:8080/x": ("a.site.fr", "site.fr", "fr"), "http://u:p@a.site.fr/": ("a.site.fr", "site.fr", "fr"), "http://A.Site.FR.:80?q": ("a.site.fr", "site.fr", "fr"), "http://10.1.2.3:80/": ("10.1.2.3", "10.1.2.3", ""), "http://[::1]:9/": ("[::1]", "[::1]", ""), "http://x.shop.co.uk/": ("x.shop.co.uk", "shop.co.uk", "uk"), "http://x.ab.com/": ("x.ab.com", "ab.com", "com"), "none": ("", "", ""), "http://localhost:1": ("localhost", "localhost", "localhost")}
    rows = spark.createDataFrame([(u,) for u in urls], "url string").withColumn("site", language_id.site_of(F.col("url")))
    got = rows.select("url", "site", language_id.domain_of(F.col("site")).alias("d"), language_id.suffix_of(F.col("site")).alias("s")).collect()
    assert {r.url: (r.site, r.d, r.s) for r in got} == {u: (a, b, c) for u, (a, b, c) in urls.items()}


def test_a_port_changes_no_evidence(spark, docs):
    train = docs.select("text", "lang")
    rows = [(10 + r.doc_id, "http://a.site.fr/", f"<p>{html.escape(r.text)}") for r in docs.filter("lang = 'fr' AND length(text) > 200").limit(15).collect()]
    rows += [(1000 + r.doc_id, "http://b.site.com/", f"<p>{html.escape(r.text)}") for r in docs.filter("lang = 'en' AND length(text) > 200").limit(15).collect()]
    rows += [(1, "http://a.site.fr/", ""), (2, "http://a.site.fr:8080/", ""), (3, "http://x@a.site.fr:1/", ""), (4, "http://b.site.com:443/", "<p>" + "the river and the house " * 60_000)]
    got = {r.page_id: r for r in language_id.identify_languages(spark.createDataFrame(rows, "page_id long, url string, html string"), train).collect()}
    assert got[1].lang == got[2].lang == got[3].lang == "fr"
    assert got[2].probability == pytest.approx(got[1].probability, abs=1e-6) and got[3].probability == pytest.approx(got[1].probability, abs=1e-6)
    assert got[4].lang == "en"


def test_fusion_is_the_brute_force_one(spark, docs):
    """Every sum is taken again for each page over the other pages alone."""
    train = docs.select("text", "lang")
    some = docs.filter("length(text) > 100").orderBy("doc_id").limit(60).collect()
    rows = [(r.doc_id, [f"http://h{k % 3}.a.{r.lang}/", f"http://b{k % 2}.site.com/x", "no url"][k % 3 if k % 4 else 0], f"<html lang='{['en', r.lang, 'xx'][k % 3]}'>" * (k % 5 > 0) + "<p>" + html.escape(r.text)[: 40 + 30 * k]) for k, r in enumerate(some)]
    rows += [(-1, None, None), (-2, "http://h1.a.de/", ""), (-3, "http://h1.a.de/", ""), (-4, "http://new.q/", "<html lang=fr>")]
    rows += [(-5, "http://h1.a.de:8080/", ""), (-6, "https://me:pw@h1.a.de:1/", "x y"), (-7, "http://10.0.0.7:80/", ""), (-8, "http://10.0.0.7/", "<html lang=de>"), (-9, "http://a.co.uk/", ""), (-10, "http://b.co.uk./", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    langs, model = language_id.trigram_model(train)
    log = {r.page_id: np.array(r.text_log) for r in language_id.text_evidence(pages.select("page_id", "html"), model).collect()}
    share = {i: np.exp(x - x.max()) / np.exp(x - x.max()).sum() for i, x in log.items()}
    told = {i: (m.group(1).lower() if (m := re.search(language_id.DECLARED, h or "")) else None) for i, _, h in rows}
    host = {i: u.split("://")[1].split("/")[0] if u and "://" in u else "" for i, u, _ in rows}
    host = {i: re.sub(r"\.?(:[0-9]*)?$", "", h.split("@")[-1]) for i, h in host.items()}
    numeric = {i: bool(re.fullmatch(r"[0-9.]+", h)) for i, h in host.items()}
    domain = {i: h if numeric[i] else ".".join(h.split(".")[-3 if re.search(r"\.[^.]{1,3}\.[a-z]{2}$", h) else -2 :]) for i, h in host.items()}
    suffix = {i: "" if numeric[i] else h.split(".")[-1] for i, h in host.items()}

    def others(i, kind, value):
        return sum((share[j] for j in share if j != i and (kind is None or kind[j] == value)), np.zeros(len(langs)))

    def fits(i, kind):
        if not kind[i]:
            return np.zeros(len(langs))
        known = sum((share[j] for j in share if j != i and kind[j]), np.zeros(len(langs)))
        return np.log((others(i, kind, kind[i]) + 1) / (known + len({x for x in kind.values() if x})))

    got = {r.page_id: r for r in language_id.identify_languages(pages, train).collect()}
    assert len(got) == len(rows)
    for i in share:
        prior = (others(i, None, None) + 1) / (others(i, None, None) + 1).sum()
        for kind in (domain, host):
            mine = others(i, kind, kind[i])
            prior = (mine + language_id.STRENGTH * prior) / (mine.sum() + language_id.STRENGTH)
        fused = log[i] + np.log(prior) + fits(i, suffix) + fits(i, told)
        p = np.exp(fused - fused.max()) / np.exp(fused - fused.max()).sum()
        assert abs(got[i].probability - p.max()) < 1e-9 and abs(p[langs.index(got[i].lang)] - p.max()) < 1e-9
        assert got[i].declared == told[i]


def test_trigram_model_is_the_brute_force_one(spark, docs):
    train = docs.select("text", "lang")
    langs, model = language_id.trigram_model(train)
    counts = {x: collections.Counter() for x in langs}
    for r in train.filter("text IS NOT NULL AND lang IS NOT NULL").collect():
        for ids in language_id.trigram_ids(r.text):
            counts[r.lang].update(ids.tolist())
    wide = 1 << language_id.HASH_BITS
    for k, lang in enumerate(langs):
        expected = np.log((np.array([counts[lang][i] for i in range(wide)]) + 0.5) / (sum(counts[lang].values()) + 0.5 * wide))
        assert np.allclose(model[k], expected, atol=1e-4)


@pytest.mark.parametrize("text", ["", "a", "ab"])
def test_short_texts_have_features_or_none(text):
    assert sum(len(x) for x in toxicity.ngram_ids(text)) >= 0 and sum(len(x) for x in language_id.trigram_ids(text)) >= 0
