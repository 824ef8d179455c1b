"""Each operator against brute force on small fixtures, with the edge cases its docstring states."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cargolake.llm import ann, decontaminate, html_text, langid, license_scan, lm, packing, quality, simhash, token_counts

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (4, "One"), (None, "no id here at all"), (5, "é" * 3000), (6, "a b " * 2000)]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- license scan

def test_license_base_and_labels(docs_of, documents):
    text = "Released under the MIT License. mit\nlicense; Apache   license\nlicensed under CC BY-NC 4.0 é"
    rows = [*ODD, (7, text), (8, "General public license " * 3)]
    out = {r.doc_id: r for r in license_scan.scan(docs_of(rows)).collect()}
    assert (out[7].n_base, out[7].first_word, out[7].base_labels, out[7].labels) == (3, 3, "apache,mit", "apache,cc-by-nc,mit")
    assert (out[8].n_base, out[8].first_word, out[8].last_word) == (3, 0, 6)
    assert (out[1].n_words, out[1].n_base, out[1].first_word, out[1].labels, out[1].score) == (0, 0, None, "", 0.0)
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = {r.doc_id: r for r in license_scan.scan(documents).collect()}
    for r in documents.collect():
        words = pattern.findall(ascii_lower(r.text))
        places = [i for p in license_scan.PHRASES for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
        assert got[r.doc_id].n_words == len(words) and got[r.doc_id].n_base == len(places)


def test_similarity_join_is_exact():
    random.seed(3)
    alphabet = [c.encode() for c in "abcdefghij"]
    templates = [(f"t{i}", " ".join(random.sample("abcdefghij", random.randint(2, 7)))) for i in range(12)]
    for threshold in (0.5, 0.8, 1.0):
        index = license_scan.template_index(templates, threshold, {c: random.randint(0, 9) for c in alphabet})
        for _ in range(300):
            block = set(random.sample(alphabet, random.randint(1, 9)))
            want = {t for t, (_, text) in enumerate(templates) if len(set(text.encode().split()) & block) >= math.ceil(threshold * len(text.split()) - 1e-9)}
            assert {t for t, _ in index.matches(block)} == want


def test_wrapped_notices(docs_of):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated files"
    bsd = "# Redistribution and use in source and binary forms, with or without\n#\n# modification, are permitted provided that"
    gpl = "This work is licensed under the\nGNU General Public\nLicense version 3"
    pad = "\n".join(f"line{i} of other words" for i in range(37))
    rows = [(1, mit), (2, bsd), (3, gpl), (4, f"{pad}\n{mit}\n{pad}"), (5, f"{pad} {bsd}"), (6, pad), (7, f"{pad}\n{mit}")]
    got = {r.doc_id: (r.labels, r.n_blocks > 0) for r in license_scan.scan(docs_of(rows)).collect()}
    assert got == {1: ("mit", True), 2: ("bsd", True), 3: ("gpl", True), 4: ("mit", True), 5: ("bsd", True), 6: ("", False), 7: ("mit", True)}


def test_every_stretch_is_in_a_block():
    random.seed(5)
    for _ in range(200):
        longest, n = random.randint(1, 6), random.randint(1, 40)
        words, lines = [b"%d" % i for i in range(n)], []
        while sum(map(len, lines)) < n:
            at = sum(map(len, lines))
            lines.append(words[at:at + random.randint(0, 20)])
        found = list(license_scan.blocks(lines, longest))
        assert all(any(set(words[at:at + longest]) <= block for block in found) for at in range(max(1, n - longest + 1)))
        assert all(len(block) <= 2 * longest for block in found)


# ---- token counts

@pytest.mark.parametrize("chunk, overlap", [(32768, 512), (200, 30), (64, 4)])
def test_token_counts(docs_of, chunk, overlap):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    random.seed(5)
    noise = ["".join(random.choice("ab  \n'sé<|>x9 ") for _ in range(500)) for _ in range(20)]
    rows = [*ODD, (20, "<|endoftext|> tail  <|endoftext|>" * 30), (21, "x" * 900), *enumerate(noise, 30)]
    out = token_counts.token_counts(docs_of(rows), path, chunk, overlap)
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or "").ids)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in out.collect()) == want


# ---- SimHash

def reference_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    ones = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def reference_classes(prints):
    """(id, fingerprint) pairs to the smallest id reachable of each row."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j, (_, b) in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= 2:
                root[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, (k, _) in enumerate(prints):
        low[find(i)] = min((x for x in (low.get(find(i)), k) if x is not None), default=None)
    return [low[find(i)] for i in range(len(prints))]


def test_simhash_classes(docs_of):
    random.seed(1)
    rows = [*ODD, *((100 + i, " ".join(random.choice("abcd") for _ in range(4))) for i in range(60))]
    out = simhash.near_duplicates(docs_of(rows)).collect()
    prints = [(i, reference_fingerprint(t)) for i, t in rows]
    want = sorted(((str(i), f"{f:016x}", str(c)) for (i, f), c in zip(prints, reference_classes(prints))))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in out) == want


@pytest.mark.parametrize("radius", [1, 2])
def test_long_buckets_lose_no_link(spark, radius):
    random.seed(radius)
    base = random.getrandbits(63)
    values = {base ^ (1 << random.randrange(63)) ^ (1 << random.randrange(63)) ^ (1 << random.randrange(8)) for _ in range(150)}
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(sorted(values))], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.classes(frame, radius).collect()}
    pairs = simhash.connected(simhash.links(frame.select("fp"), radius))
    order = sorted(values)
    root = list(range(len(order)))
    for _ in order:  # smallest label, until nothing changes
        for i, a in enumerate(order):
            root[i] = min(root[j] for j, b in enumerate(order) if (a ^ b).bit_count() <= radius)
    assert got == dict(enumerate(root)) and pairs.columns == ["node", "root"]


def test_keep_one(docs_of):
    rows = [(3, "same text of words"), (2, "same text of words"), (2, "same text of words"), (9, "other words are here now"),
            (None, "third kind of text is this"), (None, "third kind of text is this")]
    out = simhash.keep_one(docs_of(rows))
    assert out.columns == docs_of(rows).columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["2", "9", "None"]
    assert simhash.keep_one(docs_of([])).count() == 0


# ---- packing

def test_packing(docs_of):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    random.seed(2)
    odd = "abZ É.,!?;:'\n\t#İſKÅé̇   ٣½sS'Re<|>endoftext|ßẞ🙂Σς\x0b\x1c\x85"
    rows = [*ODD, *((200 + i, "".join(random.choice(odd) for _ in range(random.randint(0, 400)))) for i in range(150))]
    out = [r.asDict() for r in packing.pack(docs_of(rows), path, capacity=256).collect()]
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 256)):
            part = ids[at:at + 256]
            want[i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    used = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert used.get(r["sequence_id"], 0) == r["offset"]
        used[r["sequence_id"]] = r["offset"] + r["length"]
    total = sum(r["length"] for r in out)
    assert max(used.values()) <= 256 and len(used) <= math.ceil(total / 256) + 2
    assert packing.pack(docs_of([]), path).count() == 0


def test_equal_rows_are_spread_over_slices(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(packing, "stored", lambda df, name: kept.append(df) or df)
    docs = spark.createDataFrame([(None, "")] * 2000, "doc_id long, text string").coalesce(1)
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 64).collect()
    assert len({(r.sequence_id, r.offset) for r in out}) == 2000
    sizes = [r["count"] for r in packing.sliced(kept[0], 16).groupBy("length", "slice").count().collect()]
    assert sum(sizes) == 2000 and max(sizes) < 400


def test_bin_plan_covers_every_piece():
    random.seed(4)
    histogram = {n: random.randint(1, 40) for n in random.sample(range(1, 101), 60)}
    plan = packing.bin_plan(histogram, 100)
    for length, n in histogram.items():
        ranks = plan["rank"][plan["length"] == length]
        assert ranks[0] == 0 and (np.diff(ranks) > 0).all() and ranks[-1] < n


def test_the_program_places_nearly_all_pieces():
    random.seed(11)
    histogram = Counter(min(2047, max(2, int(random.lognormvariate(6.3, 0.8)))) for _ in range(6000))
    sizes = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[k] for k in sizes.tolist()], dtype=np.int64)
    bins, left = packing.rounded(sizes, counts, 2048)
    held = np.zeros(len(sizes), dtype=np.int64)
    for n, inside in bins:
        assert sum(int(sizes[i]) * t for i, t in inside.items()) <= 2048
        for i, t in inside.items():
            held[i] += n * t
    assert (held + left == counts).all() and (left >= 0).all()
    assert held.sum() >= 0.9 * counts.sum() and left.sum() <= len(sizes)
    sequences = sum(n for n, _ in bins) + sum(n for n, _ in packing._best_fit(sizes, left, 2048))
    assert sequences <= math.ceil(int((sizes * counts).sum()) / 2048) * 1.002 + 1


# ---- HTML

@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain", "plain"), ("<p>Hi", "Hi"), ("<nav>menu</nav><p>Caf&eacute;&nbsp;&amp;  bar</p>", "Café & bar"),
    ("<div class=with-sidebar><h1>T</h1><p>a<b>b</b>c</p><br>d</div><div class='side sidebar'>no</div>", "T abc d"),
    ("<article><p>Kept.</p><section id=comments><p>a reader's remark</p></section></article><p>outside</p><footer>f", "Kept."),
    ("<body><script>var t='</p>';</script><!-- <p>x</p> --><p>one</p><form>q</form><div role=alert>w</div><p>two</p>", "one two"),
])
def test_main_text(page, text):
    assert html_text.main_text(page or "") == text


LONG = "A long paragraph of the article itself. " * 12


@pytest.mark.parametrize("page, text", [
    ("<article><h1>Title</h1><div class=ad>buy</div><p>{0}</p></article>", "Title {0}"),
    ("<main><h1>Title</h1><article><p>{0}</p></article></main>", "Title {0}"),
    ("<article><p>{0}</p><div class=ad>buy</div><p>Short.</p><aside>more</aside><p>{0}</p></article>", "{0} Short. {0}"),
    ("<article><h1><a href=x>Title</a></h1><p>{0}</p><p><a href=y>Source</a></p></article>", "Title {0} Source"),
])
def test_a_marked_article_is_kept_whole(page, text):
    assert html_text.main_text(page.format(LONG)) == text.format(LONG.strip())


@pytest.mark.parametrize("page, text", [
    ("<article><p>{0}</p></article><section id=comments><article class=comment>{0}{0}</article><article>{0}</article></section>", "{0}"),
    ("<main><p>{0}</p><article class='comment odd'><p>remark</p></article></main>", "{0}"),
    ("<main><p>{0}</p><aside><article>teaser</article></aside><div class=related><article>teaser</article></div></main>", "{0}"),
    ("<div class=content-with-sidebar><p>{0}</p><div class=sidebar>box</div></div>", "{0}"),
    ("<div class=layout-sidebar-right><p>{0}</p></div><div class=site-footer>foot</div>", "{0}"),
    ("<div class=sidebar-page><article><p>{0}</p></article></div>", "{0}"),
    ("<main><div class=comments-open><article class='post comments-open'><p>{0}</p></article></div></main>", "{0}"),
    ("<p>{0}</p><div class=page-sidebar-box>box</div>", "{0}"),
])
def test_unwanted_elements_and_the_chief_article(page, text):
    assert html_text.main_text(page.format(LONG)) == text.format(LONG.strip())


def test_html_query_shape(spark):
    frame = spark.createDataFrame([(1, "u", None, "x"), (None, None, "<p>A</p>", "y")], "page_id long, url string, html string, text string")
    assert [(r.page_id, r.text, r.n_chars) for r in html_text.extract(frame).orderBy("text").collect()] == [(1, "", 0), (None, "A", 1)]


# ---- language and quality

def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", F.lit(0.5).alias("score"))
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in out)
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97


def test_language_edges(docs_of):
    out = {r.doc_id: r for r in langid.identify(docs_of([*ODD, (10, "1 2 !"), (11, "words of text")])).collect()}
    assert (out[1].lang_pred, out[1].score, out[10].lang_pred) == ("und", 0.0, "und") and out[None].held_out
    assert out[11].lang_pred == "en" and 0 <= out[11].score <= 1
    assert langid.identify(docs_of([])).count() == 0


def test_ngrams_over_blocks(monkeypatch):
    raw = ("Straße und Äpfel, " * 50).encode()
    whole = langid.ngram_counts(raw)
    monkeypatch.setattr(langid, "BLOCK", 37)
    for a, b in zip(whole, langid.ngram_counts(raw)):
        order = np.argsort(whole[0])
        assert (a[order] == b).all()


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    half = labels.filter("doc_id % 2 = 0")
    out = quality.classify(docs, half).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    assert sum(r.good == bool(r.quality) for r in out) / len(out) > 0.95 and all(0 <= r.score <= 1 for r in out)


def test_quality_edges(docs_of, spark):
    labels = spark.createDataFrame([(4, 1, 0), (5, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.classify(docs_of(ODD), labels).collect()] == [1.0] * len(ODD)
    assert quality.classify(docs_of([]), labels.limit(0)).count() == 0


def test_quality_labelled_rows_are_bounded_by_rows(spark, monkeypatch):
    """One labelled id holds a third of all rows: it is one row of the fit, whatever the bound of ids would let in."""
    seen = {}
    real = quality.co_train

    def watched(content, metadata, y, free, scales, **more):
        seen.update(rows=len(y), free=free.count())
        return real(content, metadata, y, free, scales, **more)

    monkeypatch.setattr(quality, "co_train", watched)
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit(7)).otherwise(F.col("id")).alias("doc_id"),
                                    F.concat(F.lit("some words of prose, "), F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, " !!! $$$ ###").otherwise(".")).alias("text"),
                                    F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(30).alias("n_chars"))
    labels = spark.createDataFrame([(7, 1)] + [(i, i % 2) for i in range(1000, 1400)], "doc_id long, quality int")
    out = quality.classify(rows, labels)
    assert out.count() == 3000 and seen == {"rows": 401, "free": 1600}
    good = {r.good for r in out.filter("doc_id >= 1400 AND doc_id % 2 = 1").collect()}, {r.good for r in out.filter("doc_id >= 1400 AND doc_id % 2 = 0").collect()}
    assert good == ({True}, {False})
    quality.learn(rows, labels, max_labelled=100)
    assert 80 <= seen["rows"] <= 100


def test_quality_sums_and_cuts_equal_plain_ones(spark):
    """Sums over all rows in Spark against numpy; the cuts take whole bins, the surest first."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = quality.measured(docs)
    held = rows.collect()
    content = np.array([list(r.m) for r in held])
    metadata = quality._metadata_matrix(*(np.array([r[c] for r in held]) for c in ("source_b", "lang_b", "log_chars")))
    got = quality._added(rows, lambda c, m: np.concatenate([c.sum(axis=0), m.sum(axis=0)]), content.shape[1] + metadata.shape[1])
    assert np.allclose(got, np.concatenate([content.sum(axis=0), metadata.sum(axis=0)]))
    assert sorted(tuple(quality.measures((r.text or "").encode())) for r in docs.collect()) == sorted(map(tuple, content))
    histogram = np.zeros(quality.BINS)
    histogram[[0, 1, 2, -3, -2, -1]] = 10
    assert quality._cuts(histogram, 30, 0.5, 0.95) == (quality.BINS - 2, 1)
    assert quality._cuts(histogram, 1e9, 0.5, 0.95) == (quality.BINS - 3, 2)
    histogram[-3:] = 0, 0, 10  # sure of fewer good rows: as much fewer bad ones
    assert quality._cuts(histogram, 30, 0.5, 0.95) == (quality.BINS - 1, 0)
    histogram[-1] = 0
    assert quality._cuts(histogram, 30, 0.5, 0.95) == (quality.BINS, -1)


# ---- language model

def test_lm_scores(docs_of, documents):
    rows = [*ODD, *((r.doc_id + 100, r.text) for r in documents.limit(60).collect())]
    out = lm.score(docs_of(rows), F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, F.lit(False)), size=64, width=8).collect()
    tokens = lambda t: [*ascii_lower(t).encode().split(), None]
    counts = Counter(w for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n,
                   round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 5)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in out) == want
    assert all(r.score < 0 for r in out)
    assert lm.score_documents(docs_of([])).count() == 0


def test_lm_is_normalised_and_learns():
    random.seed(0)
    ids = np.array([2 + i % 3 for i in range(6000)])
    unigram = np.bincount(ids, minlength=6) + 0.1
    trainer = lm.Trainer(lm.LogBilinear.start(unigram / unigram.sum(), 4), unigram / unigram.sum(), seed=1, noise=16)
    word, one, two = lm._examples(ids, 0, 1)
    for at in range(0, 6000, 100):
        trainer.step(word[at:at + 100], one[at:at + 100], two[at:at + 100])
    first, second, norm = trainer.m.tables()
    p = np.exp(first[:, None, :] + second[None, :, :] - norm[:, :, None])
    assert np.allclose(p.sum(axis=2), 1, atol=1e-4) and p[3, 2, 4] > 0.9


def test_lm_trains_on_every_token(monkeypatch):
    texts = ["a b c a b c d", "a", "", None, "b b b", "a b c a b c d"] + [f"a b c w{i} d" for i in range(40)]
    known = lm.Vocabulary([b"a", b"b", b"c"], np.array([46, 47, 44]), len(texts), 300, 45, 5)
    targets = Counter()

    class Task:
        get, partitionId = classmethod(lambda cls: cls), classmethod(lambda cls: 0)

    class Docs:  # runs the training function here, and drops its models
        select = groupBy = applyInPandas = lambda self, *_: self
        collect = lambda self: []

        def mapInArrow(self, run, schema):
            list(run(iter([pa.RecordBatch.from_arrays([pa.array(part, pa.string())], names=["text"]) for part in (texts[:3], texts[3:])])))
            return self

    monkeypatch.setattr(lm, "BATCH", 16)
    monkeypatch.setattr(lm, "TaskContext", Task)
    monkeypatch.setattr(lm, "vocabulary", lambda counts, size: known)
    monkeypatch.setattr(lm.Trainer, "step", lambda self, *example: targets.update(zip(*(x.tolist() for x in example))))
    lm.train(Docs(), None, size=5, width=4)
    want = Counter()
    for text in texts:
        ids = [{"a": 2, "b": 3, "c": 4}.get(w, lm.REST) for w in (text or "").split()] + [lm.END]
        want.update(zip(ids, [lm.END, *ids], [lm.END, lm.END, *ids]))
    assert targets == want


# ---- decontamination

def test_alignment_against_brute_force():
    random.seed(6)
    for _ in range(200):
        a, b = (np.array([random.randint(0, 3) for _ in range(random.randint(1, n))]) for n in (12, 30))
        h = np.zeros((len(b) + 1, len(a) + 1), int)
        for j in range(len(b)):
            for i in range(len(a)):
                h[j + 1, i + 1] = max(0, h[j, i] + (1 if a[i] == b[j] else -1), h[j, i + 1] - 1, h[j + 1, i] - 1)
        assert decontaminate.align(a, b)[0] == h.max()


def test_decontamination(docs_of, spark):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog near the old mill by the river", "a"), (2, None, "b"),
                                   (3, "alpha beta", "c"), (4, "", "d")], "item_id long, text string, doc_id string")
    edited = "well The QUICK, brown fox leaps over the lazy dog near that old mill by the river indeed"
    rows = [*ODD, (50, edited), (51, "the old river and the mill by a fox"), (52, "x alpha, beta y"), (53, "word " * 30000 + edited)]
    out = {(r.doc_id, r.item_id): r for r in decontaminate.contaminations(docs_of(rows), items).collect()}
    assert set(out) == {(50, 1), (52, 3), (53, 1)}
    assert out[50, 1].first_word == 1 and out[53, 1].first_word == 30001 and 0.5 < out[50, 1].score < 1
    assert sorted(r.doc_id for r in decontaminate.keep_clean(docs_of(rows), items).collect() if r.doc_id) == [1, 2, 3, 4, 4, 5, 6, 51]
    assert decontaminate.contaminations(docs_of([]), items).count() == 0
    assert decontaminate.contaminations(docs_of(rows), items.limit(0)).count() == 0


def test_a_passage_in_most_documents_is_found(docs_of, spark):
    item = "seven wise owls sat on a long branch and sang about the moon all night"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(i, f"{i} before {item} after") for i in range(200)] + [(900, "nothing of the kind")]
    assert decontaminate.contaminations(docs_of(rows), items).count() == 200


# ---- nearest neighbours

def test_index_retrieves_the_whole_radius():
    random_codes = np.random.default_rng(0).integers(0, 256, (500, 8), dtype=np.uint8)
    index = ann.Index(random_codes)
    for radius in (0, 7, 22, 30, 64):
        near = [ann.near_values(r) for r in ann.reaches(radius, 8)]
        want = np.flatnonzero(ann.hamming(random_codes, random_codes[3]) <= radius)
        assert (index.within(random_codes[3], radius, near) == want).all()


def test_nearest_neighbours(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    odd = [(None, rows[0][1]), (7000, None), (7001, [0.0] * 64), (7002, [float("nan")] * 64), (7003, [None] * 64), (7004, [1.0]),
           (7100, rows[5][1]), (7101, rows[5][1]), (7102, rows[5][1])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<float>, score int")
    out = ann.nearest(frame).collect()
    keep = rows + [r for r in odd if r[0] and r[0] >= 7100]
    ids, x = np.array([i for i, _ in keep]), np.array([v for _, v in keep], np.float32).astype(float)
    hit = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        distance = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, distance)) if j != q][:10]
        got = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == ids[q])
        assert [r for r, _, _ in got] == list(range(1, 11))
        assert all(abs(s - distance[np.flatnonzero(ids == i)[0]]) < 1e-12 for _, i, s in got)
        hit, total = hit + len({i for _, i, _ in got} & set(ids[order])), total + 10
    assert hit / total > 0.95


def test_few_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (0, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(frame).orderBy("rank").collect()] == [(0, 1, 2), (0, 2, 1)]
    assert ann.nearest(frame.limit(0)).count() == 0


# ---- faults found in review

LONG = "A long paragraph of prose that goes on for a while, so that its windows surge and nothing of it dives. " * 2


@pytest.mark.parametrize("page, wanted", [
    (f"<svg/><p>{LONG}</p>", [LONG]),
    (f"<p>{LONG}</p><iframe src=x/><p>{LONG}</p>", [LONG, LONG]),
    (f"<iframe src=x><p>{LONG}</p>", [LONG]),
    (f"<html><head><title>x</title><meta a=b><p>{LONG}</p>", [LONG]),
    (f"<head><title>x</title></head><body><title-card>Card</title-card><p>{LONG}</p>", [LONG]),
    (f"<article><h2 id='share-prices'>Prices</h2><p>{LONG}</p><h2 id=copyright-law>Law</h2><p>{LONG}</p></article>", ["Prices", LONG, "Law", LONG]),
    (f"<div class='post-header'><h1>Title</h1></div><p>{LONG}</p>", ["Title", LONG]),
    (f"<p>{LONG}</p><div class=ad>Buy</div><p>Short.</p><div class=ad>Buy</div><p>{LONG}</p>", [LONG, "Short.", LONG]),
    (f"<h1><a href=x>Linked title</a></h1><p>{LONG}</p>", ["Linked title", LONG]),
    (f"<nav><a>Menu</a></nav><p>{LONG}</p><script>if (a < b) x()</script><!-- no --><footer>Foot</footer>", [LONG]),
    (f"<SCRIPT>x</SCRIPT ><p title='a > b'>{LONG}</p><style>p > a", [LONG]),
])
def test_html_keeps_article_text(page, wanted):
    text = html_text.main_text(page)
    assert [w for w in (" ".join(x.split()) for x in wanted) if w not in text] == []
    assert not any(w in text for w in ("Buy", "Menu", "Foot", "x()", "no -->", "> b", "> a"))


@pytest.mark.parametrize("unit", ["<script", "<head", "<a '", "<svg>", "<a \">\" ", "<!-", "<", "</p", "<script>", "<iframe>x", "<p class='ad'>"])
def test_html_hostile_pages_are_read_in_linear_time(unit):
    import time
    page = unit * (1_000_000 // len(unit))
    start = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - start < 8  # on a loaded machine; quadratic time would be hours


def test_html_regions_equal_plain_ones():
    """Surge and dive against a plain reading of the rule."""
    random.seed(8)
    for _ in range(300):
        size = [random.choice([0, 0, 0, 5, 30, 90, 200]) for _ in range(random.randint(0, 25))]
        block = [sum(size[i:i + html_text.WINDOW]) for i in range(len(size))]
        least = min(html_text.SURGE, html_text.SURGE_SHARE * max(block, default=0))
        want = []
        for i in range(len(size)):
            first = next((k for k in range(i + 1) if size[k] and all(block[k:i + 1])), None)
            end = next((k for k in range(i, len(size)) if not block[k]), len(size))
            want.append(first is not None and max(block[first:end]) >= least)
        assert html_text.regions(size) == want


def test_one_id_does_not_hide_a_language(docs_of, spark):
    rows = spark.createDataFrame([(1, f"der die das und nicht ein {i}", "de") for i in range(3000)]
                                 + [(i + 10, f"the and of that is in {i}", "en") for i in range(3000)], "doc_id long, text string, lang string")
    assert langid.learn(rows, F.lit(True), docs_per_language=20).languages == ["de", "en"]
    same = spark.createDataFrame([(1, "der die das", "de")] * 2000 + [(2, "the and of", "en")] * 2000, "doc_id long, text string, lang string")
    assert langid.learn(same, F.lit(True), docs_per_language=1).languages == ["de", "en"]


def test_decontamination_takes_any_id(spark, docs_of):
    passage = "a rare passage of quite unusual words about seventeen purple walruses dancing under eleven lamps"
    docs = docs_of([(1, f"before {passage} after"), (2, "nothing of the kind is in this text at all")])
    for kind, value in (("string", "q-1"), ("double", 1.5), ("decimal(5,2)", None), ("date", None)):
        items = spark.createDataFrame([(passage,)], "text string").select(
            (F.lit(value) if value is not None else F.lit("2024-01-01" if kind == "date" else "7.25")).cast(kind).alias("item_id"), "text")
        assert [r.doc_id for r in decontaminate.keep_clean(docs, items).collect()] == [2]
        assert [r.doc_id for r in decontaminate.contaminations(docs, items).collect()] == [1]


def test_keep_one_leaves_the_callers_columns(docs_of):
    docs = docs_of([(1, "a b c d"), (2, "a b c d"), (3, "quite other words here")]).withColumn("__fp", F.lit("mine"))
    kept = simhash.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3] and {r["__fp"] for r in kept} == {"mine"}


def test_repeated_long_texts_are_counted_once_each_row(docs_of):
    text = "word " * 9000 + "end"
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = token_counts.token_counts(docs_of([(1, text)] * 20 + [(None, text)] * 20 + [(2, text + " x")]), path).collect()
    n = len(Tokenizer.from_file(path).encode(text).ids)
    assert len(out) == 41 and sorted({(str(r.doc_id), r.n_tokens) for r in out}) == [("1", n), ("2", n + 1), ("None", n)]
