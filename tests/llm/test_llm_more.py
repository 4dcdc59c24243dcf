"""Parts of cascades, ids against the library as it is, hot groups, ledgers over several runs, pipeline stages on odd rows."""

import collections
import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from txloom.llm import audio, chunks, components, mixing, packing, quality, secret_scan, sharding, similar, simhash, substring, url_filter
from txloom.llm import queries as llm


def test_levels_in_parts_are_exact(spark, monkeypatch):
    """A few bytes a part, so that keys are dealt to many cascades and URLs judged in as many passes."""
    rules = [("block" if i % 3 else "allow", f"h{i}.net", f"/p{i % 4}") for i in range(120)] + [("allow", "net", "/p1/longer/one"), ("block", "h5.net", "")]
    hosts = [f"bad{i}.org" for i in range(60)]
    r = random.Random(3)
    urls = [f"http://{r.choice(['', 'www.', 'a.b.'])}{r.choice([f'h{r.randrange(150)}.net', f'bad{r.randrange(90)}.org', 'org'])}/p{r.randrange(5)}{r.choice(['', '/longer/one', '?q'])}" for _ in range(1500)] + [None, "x"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    monkeypatch.setattr(url_filter, "MOST_BYTES", 16)
    want = []
    for u in urls:
        host, path = url_filter.split(u)
        under = lambda h: host == h or host.endswith("." + h)
        fits = [(len(h + p), -i, h + p, v) for i, (v, h, p) in enumerate(rules) if host and under(h) and path.startswith(p)]
        want.append((host, path, *max(fits)[2:]) if fits else (host, path, None, "block" if any(map(under, hosts)) else "allow"))
    got = [tuple(q)[1:] for q in url_filter.judged(df, rules, hosts).orderBy("page_id").collect()]
    assert got == want and len({w[3] for w in want}) == 2
    assert len(url_filter.cascades(url_filter.universe(df, {f"h{i}.net\0/p{i % 4}" for i in range(120)}, [3]))) > 1


def test_ids_are_the_librarys():
    """20,000 texts of all white space, added tokens, combining marks; nothing is set on the library's tokenizer."""
    from tokenizers import Tokenizer

    tok, words, r = Tokenizer.from_file(packing.vocabulary()), packing.Words(packing.vocabulary(), special=True), random.Random(5)
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()] + ["​", "﻿", "᠎"]
    odd = [*spaces, *spaces, "́", "ा", "⃝", "é", "٠", "²", "Ⅷ", "一", "İ", "ab", "Foo", "12", "'s", "'S", " 're", "...", "<|endoftext|>", "<|endoftext", "|>", "  ", "\n\n", "\t", "\r\n", "_", "’s"]
    texts = ["".join(r.choice(odd) if r.random() < 0.5 else r.choice([" ", "\n", " word", " a1", "x"]) for _ in range(r.randint(1, 16))) for _ in range(20_000)]
    for t in texts:
        assert words.ids(t) == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_op7_reads_added_tokens_as_the_library_does(spark, tmp_path):
    from tokenizers import Tokenizer

    text = "see <|endoftext|> here<|endoftext|>\n"
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.length for r in llm.QUERIES["op7_best_fit_packing"](spark, str(tmp_path)).collect()}
    assert got == {1: len(Tokenizer.from_file(packing.vocabulary()).encode(text, add_special_tokens=False).ids) + 1, 2: 1}


def copies(r, n_words, n, edits, word="x"):
    base = [f"{word}{r.integers(0, 1 << 40)}" for _ in range(n_words)]
    return [" ".join(f"e{r.integers(0, 1 << 40)}" if i in gone else w for i, w in enumerate(base)) for _ in range(n) for gone in [set(r.choice(n_words, r.integers(*edits), replace=False).tolist())]]


def jaccard(a, b):
    return len(a & b) / max(len(a | b), 1)


def test_recall_of_similar_texts(spark):
    """Of pairs just above the threshold at least nine of ten are found, of others nearly all; none below it is linked."""
    r = np.random.default_rng(4)
    texts = [t for _ in range(700) for t in copies(r, int(r.integers(60, 400)), 2, (0, 8))]
    got = {q.key: q.root for q in similar.groups(spark.createDataFrame(list(enumerate(texts)), "key long, text string")).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    near = [(jaccard(sets[i], sets[i + 1]), got[i] == got[i + 1]) for i in range(0, len(texts), 2)]
    assert not any(same for j, same in near if j < 0.8)
    close, edge = [s for j, s in near if j >= 0.85], [s for j, s in near if 0.8 <= j < 0.85]
    assert len(edge) > 50 and np.mean(edge) >= 0.9 and np.mean(close) >= 0.99


def test_odd_sketch_never_refutes_a_pair():
    r = np.random.default_rng(6)
    for n in (1, 9, 100, 3000):
        for _ in range(30):
            common, own = (r.integers(0, 1 << 63, k).astype(np.uint64) for k in (n, max(1, n // 9)))
            a, b = np.unique(common), np.unique(np.concatenate((common, own)))
            differ = int(np.bitwise_count(similar.odd_sketch(a) ^ similar.odd_sketch(b)).sum())
            assert differ <= len(np.setxor1d(a, b))


def test_a_large_group_of_copies_that_are_not_similar_enough(spark):
    r = np.random.default_rng(9)
    texts = copies(r, 146, 150, (1, 6)) + [" ".join(f"s{i}_{k}" for k in range(60)) for i in range(50)]
    got = {q.key: q.root for q in similar.groups(spark.createDataFrame(list(enumerate(texts)), "key long, text string")).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    want = [find(i) for i in range(len(texts))]
    assert len({(got[i], want[i]) for i in got}) == len(set(got.values())) == len(set(want))


def test_a_stranger_in_a_dense_bucket_is_still_linked(spark):
    """Components that share buckets with a larger one, three bits away from one of its members only."""
    r = np.random.default_rng(2)
    base = int(r.integers(0, 1 << 62))
    dense = [base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in r.integers(0, 60, (40, 2)) if a != b]
    far = dense[0] ^ 0b111 << 60
    nodes = spark.createDataFrame([(x, 1) for x in dense] + [(far - (1 << 64) if far >> 63 else far, 2)], "fp long, comp long").distinct()
    assert [(q.a, q.b) for q in simhash.links(nodes).collect()] == [(1, 2)]


def test_ledger_over_three_runs(spark):
    """Another run of the same documents scans nothing, one with new documents the new blobs, a new version all."""
    one = spark.createDataFrame([(1, "token=aaaaaaaa"), (2, None), (None, "clean")], "doc_id long, text string")
    more = one.union(spark.createDataFrame([(4, "secret: bbbbbbbb"), (5, "secret: bbbbbbbb"), (6, "clean")], "doc_id long, text string"))
    _, a = secret_scan.scan(one)
    _, b = secret_scan.scan(one, a)
    found, c = secret_scan.scan(more, b)
    _, d = secret_scan.scan(more, c, "next")
    assert [x.count() for x in (a, b, c, d)] == [3, 3, 4, 8]
    assert sorted((r.doc_id or 0, len(r.spans)) for r in found.collect()) == [(0, 0), (1, 1), (2, 0), (4, 1), (5, 1), (6, 0)]
    out = {r.doc_id: r.text for r in secret_scan.redacted(more, c).collect()}
    assert out == {1: "[SECRET]", 2: None, None: "clean", 4: "[SECRET]", 5: "[SECRET]", 6: "clean"}
    assert secret_scan.redacted(more.limit(0), c).count() == 0


def test_weak_labels_find_accuracies_closely():
    """Where labellers err independently, the truth is found without a hint of which documents are junk."""
    r = np.random.default_rng(3)
    side = [k for k, _ in quality.LABELLERS]
    for junk, speak, noise in ((0.2, 0.5, 0.01), (0.1, 0.4, 0.02), (0.5, 0.6, 0.05)):
        truth = r.random(20_000) < junk
        votes = [(truth if k else ~truth) & (r.random(len(truth)) < speak) | (r.random(len(truth)) < noise) for k in side]
        codes = sum(v.astype(int) << i for i, v in enumerate(votes))
        share, accuracy, post = quality.estimate(dict(collections.Counter(codes.tolist())))
        true = [(truth if k else ~truth)[v].mean() for k, v in zip(side, votes, strict=True)]
        assert abs(share - truth.mean()) < 0.02 and np.abs(accuracy - np.array(true)).max() < 0.03
        rate = lambda own: np.where(own, 1 - (1 - speak) * (1 - noise), noise)
        log = lambda p: sum(np.log(np.where(v, x, 1 - x)) for v, x in zip(votes, p, strict=True))
        best = np.log(junk / (1 - junk)) + log(rate(np.array(side) == 1)) - log(rate(np.array(side) == 0)) > 0
        spoken = codes > 0
        right = np.mean((np.array([post[c] for c in codes[spoken].tolist()]) > 0.5) == truth[spoken])
        assert right > np.mean(best[spoken] == truth[spoken]) - 0.005  # as good as with the true rates


def test_a_corpus_of_good_prose_alone_stays():
    share, _, post = quality.estimate({1 << 6: 5000})
    assert share < 0.05 and post[1 << 6] < 0.05


def test_sample_is_of_distinct_texts_and_bounded(spark):
    texts = ["the same text in most rows"] * 500 + [f"text {i} of its own kind" for i in range(300)]
    x, codes = quality.sample(spark.createDataFrame([(t,) for t in texts], "text string").repartition(7), 1.0, 250)
    assert len(x) == len(codes) == 250
    assert len(quality.sample(spark.createDataFrame([(t,) for t in texts], "text string").repartition(7), 1.0)[0]) == 301


def test_variety_does_not_fall_with_length():
    r = np.random.default_rng(1)
    words = [b"w%d" % i for i in np.minimum(r.zipf(1.3, 200_000), 20_000)]
    assert abs(quality.variety(words[:2000]) - quality.variety(words)) < 0.05


DOC = "doc_id long, text string, lang string, source string, n_chars long, size int, _key string"


def test_stages_on_odd_rows_and_empty_tables(spark):
    """Null and repeated doc_ids, repeated rows, texts without words, further columns with names of ours."""
    import corpus_pipeline as pipeline

    letters = lambda k: np.random.default_rng(list(k.encode())).integers(97, 123, (60, 6), np.uint8)
    prose = lambda k: f"The {k} " + " ".join(bytes(w).decode() for w in letters(k)) + "."
    rows = [(d, prose(k), "en", s, 9, 1, "x") for d, k, s in [(None, "ant", "a"), (None, "bee", "a"), (5, "cat", "b"), (5, "dog", None), (5, "dog", None), (6, "eel", "b")]]
    rows += [(None, None, None, None, None, None, None), (8, "", "en", "a", 0, 1, "x"), (8, " \n", "en", "a", 2, 1, "x"), (9, prose("fox") + " token=abcdef123", "en", "a", 1, 1, "x")]
    docs = spark.createDataFrame(rows, DOC)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0
    worded = {r[1] for r in rows if r[1] and r[1].strip()}
    assert {r.text for r in pipeline.good_quality(spark, docs, "").collect()} == worded
    first = pipeline.first_of_near_duplicates(spark, docs, "").collect()
    assert collections.Counter(r.text for r in first if r.text and r.text.strip()) == collections.Counter(worded) and len(first) == len(worded) + 1
    out = pipeline.secrets_redacted(spark, docs, "").collect()
    assert len(out) == len(rows) and all("abcdef123" not in (r.text or "") for r in out) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in out)
    mix = pipeline.mixture(spark, docs, "").toPandas()
    taken = collections.Counter(mix.text)
    assert set(taken) <= worded and taken[prose("dog")] <= 4 and all(n <= 2 for t, n in taken.items() if t != prose("dog"))
    size = lambda t: len(t.split())
    budget = 1.5 * sum(size(r[1]) for r in rows if r[1])
    assert budget - max(map(size, worded)) <= sum(size(t) * n for t, n in taken.items()) <= budget
    ends = pipeline.packed(spark, docs, "").filter(F.col("piece") == 0)
    assert ends.count() == len(rows) and sorted(r.length for r in ends.collect())[:2] == [1, 1]


def test_dedup_stage_by_brute_force(spark, sf_dir):
    """Five words, similarity of 0.8 or more: one document of each group stays."""
    import corpus_pipeline as pipeline

    from test_llm_small import near_by_brute_force

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()))
    root = near_by_brute_force([t for _, t in rows])
    assert sorted(r.doc_id for r in pipeline.first_of_near_duplicates(spark, docs, sf_dir).collect()) == [rows[i][0] for i in sorted(set(root))]


def plain_chunks(text):
    """The rules byte by byte: a rolling gear hash; the first cut under the hard mask before the target, else under the easy one."""
    h, at = 0, []
    for b in text:
        h = (h * 2 + int(chunks.GEAR[b])) % (1 << 32)
        at.append(h)
    out, start, n = collections.Counter(), 0, len(text)
    while start < n:
        end = n
        if n - start > chunks.LEAST:
            high = min(start + chunks.MOST, n)
            hard = (e for e in range(start + chunks.LEAST, min(start + chunks.TARGET, high)) if not at[e - 1] & int(chunks.HARD))
            easy = (e for e in range(start + chunks.TARGET, high) if not at[e - 1] & int(chunks.EASY))
            end = next(hard, None) or next(easy, None) or high
        out[xxhash.xxh3_64_hexdigest(text[start:end])] += end - start
        start = end
    return out


def test_chunks_equal_the_plain_rules(spark):
    r = random.Random(8)
    texts = ["", "a", "x" * 1500, "é" * 700] + ["".join(r.choice("abcdefgh \n") for _ in range(r.randrange(5, 3000))) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(50, None)]
    got = {q.doc_id: q for q in chunks.compared(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        own, edited, nxt = (plain_chunks(x.encode()) for x in (t, changed, following))
        like = lambda a, b: sum((a & b).values()) / sum(a.values()) if a and b else float(not a and not b)
        written = lambda c: ",".join(f"{d}:{w}" for d, w in sorted(c.items()))
        assert (got[i].fingerprint, got[i].edited_fingerprint, got[i].n_chars) == (written(own), written(edited), len(t))
        assert (got[i].near_edited, got[i].near_next) == (like(own, edited), like(own, nxt))


def test_tree_equals_sorting(spark):
    """The histogram rounds against plain sorting: at each node the points left of the weighted quantile of the widest dimension."""
    r = np.random.default_rng(12)
    rows = [(int(i), int(i) + 7, 0, int(r.integers(1, 400)), int(r.integers(0, 1 << 24)), int(r.integers(0, 1 << 24) if i % 3 else 5), int(r.integers(0, 1 << 18))) for i in range(600)]
    pts = spark.createDataFrame(rows, "k1 long, k2 long, part int, bytes long, hash long, d0 long, d1 long")
    got = {q.k1: q.shard for q in sharding.tree(pts, [1000.0, 1100.0, 900.0, 1000.0, 1000.0, 1000.0, 950.0, 1050.0]).collect()}
    room, want = [1000.0, 1100.0, 900.0, 1000.0, 1000.0, 1000.0, 950.0, 1050.0], {}

    def split(points, a, b):
        if b - a == 1:
            want.update({p[0]: a for p in points})
            return
        spread = [max(p[5 + i] for p in points) - min(p[5 + i] for p in points) for i in range(2)]
        dim, middle = max(range(2), key=lambda i: (spread[i], -i)), (a + b) // 2
        points = sorted(points, key=lambda p: (p[5 + dim], p[4]))
        aim, now, k = sum(p[3] for p in points) * sum(room[a:middle]) / sum(room[a:b]), 0, 0
        while k < len(points) and now + points[k][3] < aim:
            now += points[k][3]
            k += 1
        if k < len(points) and now + points[k][3] - aim <= aim - now or k == len(points):
            k += 1
        split(points[:k], a, middle)
        split(points[k:], middle, b)

    split(rows, 0, 8)
    assert got == want


def test_windows_equal_a_plain_transform(spark):
    """Resampling as one convolution, frames one by one, the discrete transform as a matrix."""
    texts = ["", "short", "a longer text about sound. " * 40, "".join(chr(33 + i * i % 90) for i in range(30_000))]
    got = collections.defaultdict(list)
    for q in audio.windows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id", "window").collect():
        got[q.doc_id].append(q)
    h, turns = audio.kernel(1, 2).astype(float), np.exp(-2j * np.pi * np.outer(np.arange(audio.FRAME), np.arange(audio.FRAME // 2 + 1)) / audio.FRAME)
    for i, t in enumerate(texts):
        data = audio.payload(t.encode())
        x = (np.frombuffer(data, np.uint8).astype(float) - 128) / 128
        y = np.convolve(x, h)[len(h) // 2 :: 2][: -(-len(x) // 2)]
        n = 1 + max(0, -(-(len(y) - audio.FRAME) // audio.HOP))
        y = np.concatenate((y, np.zeros((n - 1) * audio.HOP + audio.FRAME - len(y))))
        want = np.array([np.maximum(np.log(np.abs(y[k * audio.HOP : k * audio.HOP + audio.FRAME] * np.hanning(audio.FRAME) @ turns) ** 2 @ audio.BANK + 1e-12), audio.FLOOR) for k in range(n)])
        values = np.concatenate([np.array(q.log_mel).reshape(audio.FRAMES, audio.MELS) for q in got[i]])
        assert len(got[i]) == -(-n // audio.FRAMES) and np.allclose(values[:n], want, atol=2e-2) and (values[n:] == audio.FLOOR).all()
        assert [q.start_s for q in got[i]] == [k * audio.FRAMES * audio.HOP / audio.TARGET for k in range(len(got[i]))]
        assert got[i][-1].end_s == ((n - 1) * audio.HOP + audio.FRAME) / audio.TARGET


def test_op10_keeps_tensors_and_spans(spark, sf_dir):
    docs = llm.documents(spark, sf_dir)
    rows = audio.featured(docs).collect()
    assert len(rows) == docs.count() and all(len(w.log_mel) == audio.FRAMES * audio.MELS and w.start_s < w.end_s for r in rows for w in r.windows)
    feature = {r.doc_id: r.feature for r in llm.QUERIES["op10_audio_features"](spark, sf_dir).collect()}
    by_text = collections.defaultdict(set)
    for r in docs.collect():
        by_text[r.text].add(feature[r.doc_id])
    assert all(len(f) == 1 for f in by_text.values()) and len(set.union(*by_text.values())) == len(by_text)


def test_sound_in_blocks_is_the_whole(monkeypatch):
    data = bytes(np.random.default_rng(1).integers(0, 256, 40_000, np.uint8))
    whole = audio.analysed(audio.stored(data))
    monkeypatch.setattr(audio, "AT_A_TIME", 7)
    part = audio.analysed(audio.stored(data))
    assert part[0] == whole[0] and np.allclose(part[1], whole[1], atol=1e-4) and part[2] == whole[2]
    rate = 11_025
    x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    full = audio.resampled(x, rate, audio.TARGET)
    assert np.allclose(audio.sound(data, rate, 5000, 9000), full[5000:9000], atol=1e-5)


def test_places_whose_words_differ_are_no_repeat():
    words = [b"w%d" % i for i in range(50)]
    same = {"start": 3, "edges": 4, "digest": substring.digest_of(words[3:16])}
    other = {"start": 30, "edges": 2, "digest": substring.digest_of(words[29:40])}
    assert np.flatnonzero(substring.covered(words, [same, other], 10)).tolist() == list(range(3, 16))
    assert not substring.covered(words, None, 10).any() and len(substring.covered([], None, 10)) == 0


def test_paths_are_maximal_and_known_by_their_first_unit(spark):
    """Units a b c in two rows, and b c d in a third: a branches into the path b c, which goes on to d in one row only."""
    rows = [(1, 0, 0, 5, 1, 1), (1, 0, 5, 3, 2, 2), (1, 0, 8, 2, 3, 3), (2, 0, 40, 5, 1, 1), (2, 0, 45, 3, 2, 2), (2, 0, 48, 2, 3, 3), (3, 0, 7, 3, 2, 2), (3, 0, 10, 2, 3, 3), (3, 0, 12, 1, 4, 4), (4, 0, 9, 1, 4, 4)]
    df = spark.createDataFrame(rows, "k1 long, k2 long, start long, n long, u1 long, u2 long")
    got = sorted((r.k1, r.start, r.edges, r.u1) for r in substring.compacted(df).collect())
    assert got == [(1, 0, 5, 1), (1, 5, 5, 2), (2, 40, 5, 1), (2, 45, 5, 2), (3, 7, 5, 2), (3, 12, 1, 4), (4, 9, 1, 4)]


def test_very_long_texts_cross_the_blocks(spark):
    """A passage on the border of two blocks of hashed words, and sound of several blocks of frames."""
    n, passage = substring.BLOCK, [f"p{i}" for i in range(60)]
    words = [f"w{i}" for i in range(n - 30)] + passage + [f"v{i}" for i in range(5000)]
    short = [f"s{i}" for i in range(100)] + passage + ["end"]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(short))], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in substring.removed(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()}
    for i, w in ((1, words), (2, short)):
        kept = [x for x in w if x[0] != "p"]
        assert got[i] == (len(w), 60, hashlib.sha256(" ".join(kept).encode()).hexdigest())
    text = ("a sound that rises. " * 7 + "~" * 900) * 900
    r = audio.featured(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    data, mel, spans = audio.analysed(audio.stored(audio.payload(text.encode())))
    assert len(mel) > 2 * audio.AT_A_TIME / 2 and r.payload_sha256 == hashlib.sha256(data).hexdigest() and r.summary == audio.summary(mel, spans)
    assert len(r.windows) == -(-len(mel) // audio.FRAMES) and [(s.start_s, s.end_s) for s in r.segments] == spans


def test_components_of_nulls_and_nothing(spark):
    nodes = spark.createDataFrame([(1,), (2,), (None,), (3,)], "id long")
    links = spark.createDataFrame([(1, 2), (None, 3), (2, 2), (1, 2)], "a long, b long")
    got = {r.node: r.comp for r in components.connected(nodes, links).collect()}
    assert got == {1: 1, 2: 1, None: None, 3: 3}
    assert components.connected(nodes.limit(0), links.limit(0)).count() == 0
    assert {r.comp for r in components.connected(nodes, links.limit(0)).collect()} == {1, 2, 3, None}


def test_mix_by_brute_force(spark):
    """All copies in one list by virtual time; repeated and null doc_ids, empty texts, a null source."""
    r = random.Random(6)
    rows = [(r.choice([None, *range(40)]), " ".join("w" for _ in range(r.randrange(0, 30))), r.choice(["a", "b", "c", None])) for _ in range(300)]
    got = collections.Counter((q.doc_id, q.source, q["size"], q.taken) for q in mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("doc_id", "source", "size", "taken").collect())
    docs = [(d, s, len(t.split()), hashlib.md5(f"mix|{'-' if d is None else d}".encode()).hexdigest()) for d, t, s in rows]
    total = collections.Counter()
    for _, s, n, _ in docs:
        total[s] += n
    aims = {q.source: q.target for q in mixing.targets(spark.createDataFrame([(s, n) for _, s, n, _ in docs], "source string, size long")).collect()}
    copies, low = [], lambda d: (d is not None, d or 0)
    for s in total:
        words = 0
        for k, (d, _, n, place) in enumerate(sorted((x for x in docs if x[1] == s), key=lambda x: (x[3], low(x[0]), x[2]))):
            words += n
            copies += [((i * total[s] + words) / aims[s], place, low(d), n, (s, k)) for i in range(2) if n]
    left, taken = 1.5 * sum(total.values()), collections.Counter()
    for _, _, _, n, who in sorted(copies, key=lambda c: c[:4]):
        if n > left:
            break
        left -= n
        taken[who] += n
    want = collections.Counter()
    for s in total:
        for k, (d, _, n, _) in enumerate(sorted((x for x in docs if x[1] == s), key=lambda x: (x[3], low(x[0]), x[2]))):
            want[d, s, n, taken[s, k]] += 1
    assert got == want


def test_pivot_table_discards_by_the_greatest_coordinate_difference(spark):
    """Over references with inverted blocks; no pair within the limit goes, most random ones do, and the stage asks the table first."""
    r = np.random.default_rng(3)
    fps = r.integers(0, 1 << 64, (40, similar.BITS // 64), np.uint64)
    rows = [similar.pivot_distances(f) for f in fps]
    block = lambda f, i: int(f[i // 16]) >> 4 * (i % 16) & 15
    for a, b in ((0, 1), (2, 3), (4, 4)):
        d = [[(block(fps[x], i) ^ block(similar.REFERENCE, i)).bit_count() for i in range(similar.BLOCKS)] for x in (a, b)]
        inverted = [x < y for x, y in zip(*d, strict=True)]  # the reference at which the coordinates differ most
        coordinate = [sum(4 - v if inv else v for v, inv in zip(side, inverted, strict=True)) for side in d]
        assert int(np.bitwise_count(rows[a] ^ rows[b]).sum()) == coordinate[0] - coordinate[1]
    far = [int(np.bitwise_count(rows[i] ^ rows[j]).sum()) > similar.LIMIT for i in range(40) for j in range(i)]
    assert sum(far) > 0.9 * len(far)
    for f, p in zip(fps, rows, strict=True):
        bits = np.unpackbits(f.view(np.uint8))
        bits[r.choice(similar.BITS, similar.LIMIT, replace=False)] ^= 1
        assert int(np.bitwise_count(similar.pivot_distances(np.packbits(bits).view(np.uint64)) ^ p).sum()) <= similar.LIMIT
    # nodes of equal fingerprints whose rows of the table are too far apart are discarded by the table
    names = ["node", "n", *similar.FP, *similar.PIVOTS]
    nodes = spark.createDataFrame([(1, 9, *[5] * 8), (2, 9, *[5] * 8), (3, 9, *[5] * 4, *[-6] * 4)], ", ".join(f"{c} long" for c in names))
    hubs = spark.range(1).select(F.lit(0).alias("key"), F.lit(1).cast("long").bitwiseXOR(F.xxhash64(F.lit(0))).alias("lo"))
    rows = spark.createDataFrame([(2,), (3,)], "node long").crossJoin(hubs)
    assert [tuple(p) for p in similar.star_pairs(nodes, rows).collect()] == [(1, 2)]
