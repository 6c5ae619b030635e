"""Operators that learn: toxicity, language identification, language models, and the pipeline."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_near_copies import brute_kept

from seqlake.llm import elias_fano, langid, lm_score, toxicity
from seqlake.llm.common import table


def test_elias_fano_round_trips():
    rng = np.random.default_rng(1)
    for values in ([], [0], [0, 0, 0], [5, 5, 9], rng.integers(0, 1 << 63, 1000), rng.integers(0, 50, 1000), [0, (1 << 64) - 1]):
        v = np.sort(np.array(values, np.uint64))
        assert (elias_fano.decode(elias_fano.encode(v)) == v).all() and len(elias_fano.decode(elias_fano.encode(v))) == len(v)
    v = np.sort(rng.integers(0, 1 << 40, 10_000).astype(np.uint64))
    assert len(elias_fano.encode(v)) < 10_000 * (2 + math.log2((1 << 40) / 10_000) + 1) / 8 + 256


def test_trie_finds_what_is_there_and_nothing_else(tmp_path):
    rng = random.Random(2)
    grams = sorted({(rng.randrange(1, 1 << 64, 1 << 50), rng.randrange(1 << 32)) for _ in range(2000)})
    first, second = (np.array(x, np.uint64) for x in zip(*grams, strict=True))
    p = np.linspace(1e-6, 1, len(grams))
    contexts, start = np.unique(first, return_index=True)
    data = elias_fano.Trie.build(contexts, np.append(start, len(first)), second, p, np.linspace(0, 1, len(contexts)))
    (tmp_path / "trie").write_bytes(data)
    for trie in (elias_fano.Trie(data), elias_fano.Trie.open(tmp_path / "trie"), elias_fano.Trie.mapped(data)):
        codes, weights = trie.find(first, second)
        assert np.abs(np.log10(elias_fano.VALUE[codes]) - np.log10(p)).max() <= 0.5 / elias_fano.STEPS + 1e-9
        assert (weights == elias_fano.quantise(np.linspace(0, 1, len(contexts)))[np.searchsorted(contexts, first)]).all()
        assert not trie.find(first + np.uint64(1), second)[0].any() and not trie.find(first, second ^ np.uint64(1 << 33))[0].any()
    none = np.zeros(0, np.uint64)
    empty = elias_fano.Trie(elias_fano.Trie.build(none, np.zeros(1, np.int64), none, np.zeros(0), np.zeros(0)))
    assert not empty.find(first, second)[0].any() and len(elias_fano.Trie(data).find(none, none)[0]) == 0


def test_levels_stay_coded_when_they_are_searched(monkeypatch):
    """A query reads the places it needs: no level is decoded, and what it touches does not grow with the trie."""
    monkeypatch.setattr(elias_fano, "decode", None)
    touched = {}
    for n in (1_000, 100_000):
        first = np.arange(n, dtype=np.uint64) // np.uint64(20) * np.uint64(977)
        contexts, start = np.unique(first, return_index=True)
        data = elias_fano.Trie.build(contexts, np.append(start, n), np.arange(n, dtype=np.uint64) % np.uint64(20) * np.uint64(1 << 35), np.full(n, 0.1), np.full(len(contexts), 0.5))
        trie, reads = elias_fano.Trie.mapped(data), []
        low = elias_fano.EliasFano._low
        monkeypatch.setattr(elias_fano.EliasFano, "_low", lambda self, i: (reads.append(len(i)), low(self, i))[1])
        assert trie.find(first[777:778], np.array([17 << 35], np.uint64))[0][0] > 0
        monkeypatch.setattr(elias_fano.EliasFano, "_low", low)
        touched[n] = sum(reads)
        assert isinstance(trie.successors.low, np.ndarray) and trie.successors.low.base is not None and len(data) < 9 * n + 500
    assert touched[100_000] <= touched[1_000] + 5


def test_elias_fano_finds_places():
    rng = np.random.default_rng(5)
    for draw in (rng.integers(0, 1 << 62, 3000), rng.integers(0, 3000, 3000), np.concatenate([rng.integers(0, 1 << 50, 50), (1 << 61) + np.arange(4000)])):
        v = np.unique(draw).astype(np.uint64)
        e = elias_fano.EliasFano(np.frombuffer(elias_fano.encode(v), np.uint8))
        ask = np.concatenate([v, v + np.uint64(1), [np.uint64(0), np.uint64((1 << 64) - 1)]])
        at = np.searchsorted(v, ask)
        want = np.where((at < len(v)) & (v[np.minimum(at, len(v) - 1)] == ask), at, -1)
        assert (e.find(ask) == want).all() and (e[np.arange(len(v))] == v).all()
        assert (e.find(v, np.full(len(v), 10), np.full(len(v), 20)) == np.where((np.arange(len(v)) >= 10) & (np.arange(len(v)) < 20), np.arange(len(v)), -1)).all()


def lm_brute(rows):
    tokens = [[w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + ["\n"] for _, t in rows]
    held = [zlib.crc32(("" if k is None else str(k)).encode()) % 5 == 1 for k, _ in rows]
    c, c2 = collections.Counter(), collections.Counter()
    for w, h in zip(tokens, held, strict=True):
        if not h:
            c.update(w)
            c2.update(zip(["\n", *w], w, strict=False))
    n, v, k, types = sum(c.values()), len(c), lm_score.DISCOUNT, collections.Counter(a for a, _ in c2)
    single = lambda x: (c[x] + 0.5) / (n + 0.5 * (v + 1))
    out = []
    for (key, _), w, h in zip(rows, tokens, held, strict=True):
        share = lambda a, b: max(c2[a, b] - k, 0) / c[a] + k * types[a] / c[a] * single(b) if c[a] else single(b)
        s = sum(math.log10(min(1, share(a, b))) for a, b in zip(["\n", *w], w, strict=False))
        out.append((key, h, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10(single(x)) for x in w), s))
    return out


def test_language_model_matches_brute_force(spark, rough, sf_dir, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 20_000)  # many blocks and shards
    docs = table(spark, sf_dir, "documents").limit(80).select("doc_id", "text").unionByName(rough.select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    tries = []
    got = sorted(map(tuple, lm_score.score(spark.createDataFrame(rows, docs.schema).repartition(3), tries=tries).collect()), key=repr)
    want = sorted(lm_brute(rows), key=repr)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-7 * max(1, abs(w[5])) and abs(g[6] - w[6]) <= 0.02 * abs(w[6]) + 0.05
    assert sum(elias_fano.Trie(bytes(r.trie)).contexts.n for r in tries[0].collect()) > 1000
    assert lm_score.score(docs.where(F.lit(False))).collect() == []


def test_language_model_without_training_documents(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    out = lm_score.score(spark.createDataFrame([(i, "a b a") for i in ids], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in out] == [(4, 0, 0, 0.0)] * 3


def test_toxicity_on_held_out_documents(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    rows = toxicity.held_out_scores(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    right = sum(r.predicted == r.toxic for r in held) / len(held)
    found = [r.predicted for r in held if r.toxic]
    assert right >= 0.95 and sum(found) >= 0.7 * len(found)


def test_every_sentence_takes_part_in_the_noisy_or(spark):
    model = toxicity.Model({"gronk": 4.0}, -2.0, -7.0)
    p, quiet = 1 / (1 + math.exp(-2.0)), 1 / (1 + math.exp(7.0))
    assert abs(model.score("you gronk. one. two! ... \n three?") - (1 - (1 - p) * (1 - quiet) ** 3)) < 1e-12
    assert 0 < model.score("one.") < model.score("one. two.") < 0.01 and model.score("... !?") == 0.0 == model.score(None)
    d = "/root/testdata/sf0.01"
    scores = [r.score for r in toxicity.held_out_scores(table(spark, d, "documents"), table(spark, d, "labels")).where("not held_out").collect()]
    assert sum(x == 0 for x in scores) < 0.02 * len(scores)


def test_toxicity_locates_sentences_and_takes_rough_input(spark, rough):
    rng = random.Random(8)
    calm = lambda: " ".join(rng.choices("the sun and a tree are green in spring when rain comes".split(), k=8)) + ". "
    docs, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        docs.append((i, "".join(calm() + ("You gronk of a blarg. " if bad and j == 2 else "") for j in range(5))))
        labels.append((i, int(bad)))
    labels += [(None, 1), (5, None), (0, 1), (9999, 1)]
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(d, y)
    out = toxicity.score(d, model, spans="spans").collect()
    assert all((r.score >= 0.3) == (r.doc_id % 3 == 0) for r in out)
    spans = [(r.text[s.start : s.end].strip()) for r in out for s in r.spans]
    assert set(spans) == {"You gronk of a blarg"} and len(spans) == 100
    kept = toxicity.calm(rough, y)
    assert kept.columns == rough.columns and kept.count() == rough.count()
    assert {r.score for r in toxicity.held_out_scores(rough, y.limit(0)).collect()} == {0.0}
    assert toxicity.held_out_scores(rough.limit(0), y).collect() == [] and toxicity.Model({}, 0.0).score(None) == 0.0


def test_languages(spark, rough):
    d = "/root/testdata/sf0.01"
    docs, pages = table(spark, d, "documents"), table(spark, d, "pages")
    rows = langid.languages_of(docs, pages).join(docs.select("doc_id", F.col("lang").alias("true")), "doc_id", "left").collect()
    held = [r for r in rows if r.kind == "document" and r.held_out]
    assert len(rows) == docs.count() + pages.count() and sum(r.lang == r.true for r in held) >= 0.98 * len(held)
    odd = pages.limit(3).unionByName(spark.createDataFrame([(None, None, None), (1, "", ""), (1, "", ""), (2, "http://a.example.org/fr/x", None)], pages.schema))
    out = langid.languages_of(docs.select("doc_id", "text", "lang", "source").unionByName(rough.select("doc_id", "text", "lang", "source")), odd).collect()
    assert len(out) == docs.count() + rough.count() + 7 and all(0 < r.probability <= 1 for r in out)
    assert {r.lang for r in langid.languages_of(rough, odd).collect()} == {None}
    assert langid.languages_of(docs.limit(0), pages.limit(0)).collect() == []


def test_what_is_declared_decides_where_text_says_nothing(spark):
    docs = spark.createDataFrame([(i, "le la les un une et est " * 5 if i % 2 else "the and of to in is that " * 5, "fr" if i % 2 else "en", f"s{i}") for i in range(80)], "doc_id long, text string, lang string, source string")
    page = lambda i, lang, text: (i, f"http://h{i}.example.org/{lang}/{i}", f"<html lang='{lang}'><script>x</script><p>{text}</p></html>")
    pages = spark.createDataFrame([page(i, "fr" if i % 2 else "en", "le la les un une et est" if i % 2 else "the and of to in is that") for i in range(40)] + [page(100, "fr", ""), page(101, "en", "")], "page_id long, url string, html string")
    got = {r.page_id: r.lang for r in langid.languages_of(docs, pages).where("kind = 'page'").collect()}
    assert got[100] == "fr" and got[101] == "en"


def brute_posteriors(rows, languages):
    """rows: (log-likelihoods, declared, part, host); every count leaves the row itself out."""
    k, host = len(languages), lambda h: (h or "").lower()
    code = lambda c: m[1] if (m := re.fullmatch("([a-z]{2,3})(?:[-_][a-z0-9]{2,8})?", (c or "").lower())) else ""
    domain, ending = lambda h: ".".join(host(h).split(".")[-2:]), lambda h: code(host(h).split(".")[-1]) if "." in host(h) else ""
    vote = [int(np.argmax(s)) if max(s) > min(s) else None for s, *_ in rows]
    out = []
    for i, (said, declared, part, h) in enumerate(rows):
        others = [j for j in range(len(rows)) if j != i and vote[j] is not None]
        count = lambda f: np.array([sum(vote[j] == x and f(rows[j]) for j in others) for x in range(k)], float)  # noqa: E731, B023
        every = count(lambda r: True)
        p = (every + 1) / (every + 1).sum()
        for level in (lambda r: domain(r[3]) == domain(h), lambda r: host(r[3]) == host(h)):  # noqa: B023
            n = count(level) + langid.PRIOR * p
            p = n / n.sum()
        z = np.array(said) + np.log(p)
        for mine, of in ((code(declared), lambda r: code(r[1])), (ending(h), lambda r: ending(r[3])), (code(part), lambda r: code(r[2]))):
            if mine:
                z += np.log((count(lambda r: of(r) == mine) + 0.5) / (every + 1))  # noqa: B023
        e = np.exp(z - z.max())
        out.append((languages[int(z.argmax())], float(1 / e.sum()), None if vote[i] is None else languages[vote[i]]))
    return out


@pytest.mark.parametrize("hosts", [100_000, 0])
def test_evidence_is_fused_as_brute_force_does(spark, monkeypatch, hosts):
    monkeypatch.setattr(langid, "BROADCAST_HOSTS", hosts)
    rng = random.Random(6)
    speech = {"en": "the and of to in is that it", "fr": "le la les un une et est que", "de": "der die das und ist nicht ein zu"}
    model = langid.train(spark.createDataFrame([(t * 3, lang) for lang, t in speech.items()], "text string, lang string"))
    rows = []
    for i in range(60):
        lang = rng.choice(list(speech))
        text = rng.choice((" ".join(rng.choices(speech[lang].split(), k=rng.randrange(1, 9))), "", None, "xq"))
        rows.append((i, text, rng.choice((lang, f"{lang}-XX", "zz9", None, "")), rng.choice((lang.upper(), "img", None)), rng.choice((f"Wiki.example.{lang}", f"wiki.EXAMPLE.{lang}", f"a.b.example.{lang}", "Host", "host", "", None, "x.org")), "__x"))
    rows += rows[:3]
    df = spark.createDataFrame(rows, "id int, text string, declared string, suffix string, host string, `__keep` string")
    said = {r.id: list(r.s) for r in langid.with_likelihoods(df.select("id", "text"), model, "text", "s").collect()}
    want = brute_posteriors([(said[r[0]], r[2], r[3], r[4]) for r in rows], model[0])
    out = langid.identify(df, model)
    assert out.columns == ["id", "__keep", "lang", "probability", "text_lang"]
    key = lambda x: (x[0], x[1], x[2], str(x[3]))
    got = sorted(((r.id, r.lang, round(r.probability, 9), r.text_lang) for r in out.collect()), key=key)
    assert got == sorted(((r[0], lang, round(p, 9), t) for r, (lang, p, t) in zip(rows, want, strict=True)), key=key)


def test_many_labels_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    docs = spark.createDataFrame([(f"text {i}", f"junk{i}") for i in range(20)] + [("le la les", "fr")] * 3 + [("the and of", "en")] * 2 + [("x", None)], "text string, lang string")
    assert langid.train(docs)[0] == ["en", "fr"]


def test_pipeline_stages(spark, sf_dir, rough):
    import corpus_pipeline as p
    from seqlake.llm import decontam

    docs = table(spark, sf_dir, "documents")
    calm = p.drop_toxic(spark, docs, sf_dir)
    scores = {r.doc_id: r.predicted for r in toxicity.held_out_scores(docs, table(spark, sf_dir, "labels")).collect()}
    assert {r.doc_id for r in calm.collect()} == {k for k, v in scores.items() if not v}
    alone = p.near_dedup(spark, docs, sf_dir)
    # Five words and a Jaccard similarity of 0.8, by brute force: not op9's four words and four bits.
    assert {r.doc_id for r in alone.collect()} == brute_kept([(r.doc_id, r.text) for r in docs.collect()])
    clean = p.decontaminate(spark, docs, sf_dir)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in decontam.contamination(docs, table(spark, sf_dir, "benchmark")).collect() if not r.contaminated}
    safe = p.redact_secrets(spark, docs, sf_dir)
    assert all(r.n_chars == len(r.text) for r in safe.collect()) and safe.count() == docs.count()
    for stage in (calm, alone, clean, safe):
        assert stage.columns == docs.columns
    empty = p.pack(spark, docs.limit(0), sf_dir)
    assert empty.collect() == []


def test_the_whole_pipeline(spark, sf_dir):
    """What is left, stage after stage, and every token of it: each decision by brute force or by the operator's own tested result."""
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as p
    from seqlake.llm import decontam, secret_scan

    docs = table(spark, sf_dir, "documents")
    toxic = {r.doc_id for r in toxicity.held_out_scores(docs, table(spark, sf_dir, "labels")).where("predicted = 1").collect()}
    left = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in toxic]
    kept = brute_kept(left)
    left = spark.createDataFrame([r for r in left if r[0] in kept], "doc_id long, text string")
    dirty = {r.doc_id for r in decontam.contamination(left, table(spark, sf_dir, "benchmark")).collect() if r.contaminated}
    texts = {r.doc_id: r.text for r in secret_scan.redact(left.where(~F.col("doc_id").isin(dirty))).collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for k, t in texts.items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % 2048 + 1
        for piece, (a, b) in enumerate(zip([0, *range(first, len(ids), 2048)], range(first, len(ids) + 1, 2048), strict=True)):
            want.add((k, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    out = p.run(spark, sf_dir).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out} == want and len(out) == len(want)
    assert toxic and dirty and len(kept) < docs.count() - len(toxic)
    used = collections.defaultdict(list)
    for r in out:
        used[r.sequence_id].append((r.offset, r.length))
    for places in used.values():
        assert [o for o, _ in sorted(places)] == np.cumsum([0, *(n for _, n in sorted(places))])[:-1].tolist() and sum(n for _, n in places) <= 2048


def test_stages_take_rough_rows(spark, sf_dir, rough):
    """Nulls in every column, empty and long texts, repeated rows and clashing names: a defined result in each stage."""
    import corpus_pipeline as p

    n, ids = rough.count(), lambda df: sorted(str(r.doc_id) for r in df.collect())
    for stage, keeps in ((p.drop_toxic, n), (p.decontaminate, n), (p.redact_secrets, n)):
        out = stage(spark, rough, sf_dir)
        assert out.columns == rough.columns and ids(out) == ids(rough) and out.count() == keeps
    assert {r.doc_id: r.n_chars for r in p.redact_secrets(spark, rough, sf_dir).collect()}[4] is None
    packed = p.pack(spark, rough, sf_dir).collect()
    assert {str(r.doc_id) for r in packed} == set(ids(rough)) and sum(r.piece == 0 for r in packed) == n
    for stage in p.STAGES[:-1]:
        assert stage[1](spark, rough.limit(0), sf_dir).collect() == []

