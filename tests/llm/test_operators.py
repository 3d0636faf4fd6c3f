"""Each operator against brute force or planted cases on small tables with nulls, empty and long texts, ties, repeated
rows, no rows, and extra columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from braidwork.llm import decontaminate, htmltext, linededup, media, mixing, ngram_join, quality, shard, substring, toxicity
from braidwork.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, label string"


def frame(spark, texts, start=0):
    rows = [(start + i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    make = lambda n: [vocabulary[i] for i in rng.integers(0, 3000, n)]
    out = [None, "", " \t\n", "one", "one two three", "ONE two three", "one two three"]
    base, passage, line = make(120), make(60), make(14)
    for k in range(60):  # near copies around one text
        w = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 9)):
            w[at] = f"x{k}_{at}"
        out.append(" ".join(w))
    for k in range(50):  # a common line in short texts
        out.append(" ".join(line) + "\n" + " ".join(make(int(rng.integers(1, 20)))))
    for k in range(30):  # a passage in long texts
        w = make(200)
        w[k : k] = passage
        out.append(" ".join(w) + ("\n" + "a b c d e f\nz z z" if k % 2 else ""))
    out += [out[70]] * 12 + [" ".join(make(9000))] + [" ".join(make(40)) for _ in range(40)]
    return out


def test_shards_differ_by_one_row_and_slots_are_gapless(spark, texts):
    df = frame(spark, texts)
    rows = shard.shard_rows(df, 24).collect()
    assert len(rows) == len(texts)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 8, zlib.crc32(t), "rows", None)
    counts = [len(v) for v in by.values()]
    assert max(counts) - min(counts) <= 1 and len(by) == 24
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    grown = {r.doc_id: r.shard for r in shard.shard_rows(df, 25).collect()}
    assert np.mean([grown[r.doc_id] != r.shard for r in rows]) < 0.5
    assert shard.shard_rows(df.limit(0)).count() == 0
    twice = shard.shard_rows(df.unionAll(df).withColumn("doc_id", shard.F.lit(None).cast("long")), 7).collect()
    assert len({(r.shard, r.slot) for r in twice}) == 2 * len(texts)


def test_ring_overflow_goes_on_clockwise():
    ranges = shard.fill({0: 1000}, 8)
    assert sorted(n for _, a, b, _, _ in ranges for n in [b - a]) == [125] * 8


def brute_links(texts):
    sets = []
    for t in texts:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(sets)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: (len(s), top(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("group", [2, 4, 8])
def test_ngram_join_is_brute_force(spark, texts, group):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(frame(spark, texts), group=group).collect()}
    assert found == brute_links(texts)


def test_ngram_join_without_rows_or_keys(spark):
    assert ngram_join.ngram_join(frame(spark, ["a b c"]).limit(0)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (None, "q r s"), (0, "q r s t")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in ngram_join.ngram_join(rows).collect()), key=str) == [(0, 0), (3, 3), (None, 3), (None, None)]
    # A row without a key joins two that are not linked themselves.
    w = [f"w{i}" for i in range(54)]
    chain = spark.createDataFrame([(8, " ".join(w[:44])), (None, " ".join(w[:50])), (5, " ".join(w[6:54]))], "doc_id long, text string")
    assert {r.component_id for r in ngram_join.ngram_join(chain).collect()} == {5}


def test_subsets_of_partitions_lose_no_link():
    """Linked sets in a band share at least the slack, however the differences fall, unless both are poor in it."""
    rng = np.random.default_rng(1)
    draw = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
    met = 0
    for n in (48, 63, 64, 90, 130, 200, 900, 3000):
        for grow in (0, 0.05, 0.2, 1 / 3):
            for _ in range(12):
                a = np.unique(draw(n))
                k = (len(a) + int(len(a) * (1 + grow))) // 7
                lost = max(0, (k - int(len(a) * grow)) // 2)
                b = np.unique(np.r_[rng.permutation(a)[: len(a) - lost], draw(max(0, int(len(a) * grow) + lost))])
                if 4 * len(np.intersect1d(a, b)) < 3 * len(np.union1d(a, b)):
                    continue
                shared = set(ngram_join.bands(len(a))) & set(ngram_join.bands(len(b)))
                assert shared
                for band in shared - {0}:
                    sig, of, poor = ngram_join.signatures([a, b], [band, band])
                    if not poor.all():
                        met += 1
                        assert len(np.intersect1d(sig[of == 0], sig[of == 1])) >= ngram_join.slack_of(band, 0)
    assert met > 200


def test_outlines_never_overstate_how_sets_differ():
    rng = np.random.default_rng(2)
    pa = pytest.importorskip("pyarrow")
    for n, m in ((3, 3), (40, 52), (95, 97), (700, 800), (4000, 5200)):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        for common in (0, n // 2, n):
            b = np.unique(np.r_[a[:common], rng.integers(0, 2**64, max(0, m - common), dtype=np.uint64)])
            crowded = np.unique(rng.integers(0, 2**56, m, dtype=np.uint64))  # all in few cells
            for x, y in ((a, b), (b, a), (a, crowded), (crowded, np.r_[crowded[5:], b])):
                y = np.unique(y)
                bound = ngram_join.apart(*(pa.scalar(ngram_join.outline(v), pa.binary()) for v in (x, y)))
                assert bound <= len(np.setxor1d(x, y))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(7, 7)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.label for r in rows} == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 120)}


def test_substring_dedup_is_brute_force(spark, texts):
    first, out = {}, {}
    for i, t in enumerate(texts):
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - 49):
            if first.setdefault(tuple(w[j : j + 50]), i) < i:
                gone[j : j + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = substring.substring_dedup(frame(spark, texts), keep_text=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == out
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got if r.kept is not None)
    assert any(v[1] for v in out.values()) and substring.substring_dedup(frame(spark, ["a"]).limit(0)).count() == 0
    null_key = spark.createDataFrame([(None, texts[-2]), (1, texts[-2])], "doc_id long, text string")
    assert [r.n_removed for r in substring.substring_dedup(null_key).collect()] == [0, 0]


def brute_lines(texts):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        lines = t.split("\n") if t else []
        gone = set()
        for j in range(len(lines) - 1):
            if (lines[j], lines[j + 1]) in seen:
                gone |= {j, j + 1}
            seen.add((lines[j], lines[j + 1]))
        out[i] = (len(lines), sorted(gone))
    return out


def test_repeated_lines(spark):
    run = "alpha\nbeta\ngamma\ndelta"
    df = frame(spark, [run, "x\n" + run + "\ny", None, "", "alpha\nq", run + "\n" + "m\nn\no\nm\nn\no", run])
    got = {r.doc_id: (r.n_lines, r.removed) for r in linededup.repeated_lines(df).collect()}
    assert got == {0: (4, []), 1: (6, [1, 2, 3, 4]), 2: (0, []), 3: (0, []), 4: (2, []), 5: (10, [0, 1, 2, 3, 7, 8, 9]), 6: (4, [0, 1, 2, 3])}
    cut = {r.doc_id: r.text for r in linededup.without_repeated_lines(df).collect()}
    assert (cut[0], cut[1], cut[2], cut[3], cut[5], cut[6]) == (run, "x\ny", None, "", "m\nn\no", "")
    assert linededup.repeated_lines(df.limit(0)).count() == 0


def test_repeated_lines_are_brute_force(spark, texts):
    rng = np.random.default_rng(6)
    more = ["p\nq\nB\nC\nr\ns", "A\nB\nC\nD", "A\nB\nC\nD", "B\nC", "\n\n\n\n", "\n"] + ["\n".join(rng.choice(list("abcdef "), rng.integers(1, 40))) for _ in range(80)]
    every = more + texts
    got = {r.doc_id: (r.n_lines, r.removed) for r in linededup.repeated_lines(frame(spark, every)).collect()}
    assert got == brute_lines(every)


def test_repeated_lines_with_null_and_repeated_keys_and_long_texts(spark):
    long = "\n" * 50000
    rows = [(None, "a\nb\nc"), (4, "z\na\nb"), (4, "z\na\nb"), (5, "z\na"), (6, long), (7, None)]
    got = collections.Counter((r.doc_id, r.n_removed) for r in linededup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(None, 0): 1, (4, 2): 2, (5, 2): 1, (6, 50000): 1, (7, 0): 1}
    unique = spark.createDataFrame([(6, long), (7, "a")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in linededup.without_repeated_lines(unique).collect()} == {6: "", 7: "a"}


def test_decontamination_is_exact(spark, texts):
    item = " ".join(words(texts[130])[10:45])
    items = spark.createDataFrame([(1, item), (2, item.upper()), (3, None), (4, "no such words in any text here"), (None, item), (5, "one")], "item_id long, text string")
    rows = decontaminate.contaminated(frame(spark, texts), items).collect()
    low = lambda t: words((t or "").lower())
    sh = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    expected = {(d, i) for d, t in enumerate(texts) for i, x in ((1, item), (2, item), (5, "one")) if len(sh(low(t)) & sh(low(x))) >= 0.75 * len(sh(low(x)))}
    assert {(r.doc_id, r.item_id) for r in rows} == expected and expected
    kept = {r.doc_id for r in decontaminate.clean(frame(spark, texts), items).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in expected}


def kept_shares(rows, d):
    """Expected kept tokens and own tokens of each value, as shares of all tokens."""
    total, kept, own = sum(r.n_tokens for r in rows), collections.Counter(), collections.Counter()
    for r in rows:
        kept[r[d]] += r.n_tokens * r.rate / total
        own[r[d]] += r.n_tokens / total
    return kept, own


def test_mixing_meets_its_marginals(spark, texts):
    df = frame(spark, texts * 3)
    rows = mixing.mix(df).collect()
    assert len(rows) == df.count() and all(0 <= r.rate <= 1 for r in rows)
    rates = mixing.cell_rates(mixing._rows(df, "doc_id", "text")).collect()
    for d in mixing.DIMS:
        kept, own = kept_shares(rows, d)
        target = {r[d]: r["target_" + d] for r in rates}
        wish = {v: s**0.5 for v, s in own.items() if s}
        free = {v for v in wish if target[v] < 0.9499 * own[v]}
        for v, s in own.items():
            assert abs(kept[v] - target[v]) <= 0.01 * target[v] + 1e-9 and target[v] <= 0.9501 * s
        ratio = [target[v] / wish[v] for v in free]
        assert max(ratio, default=1) <= 1.001 * min(ratio, default=1)  # in proportion to the tempered shares
        assert all(target[v] / wish[v] <= 1.001 * min(ratio, default=1) for v in wish)
    assert mixing.sampled(df).count() == sum(r.kept for r in rows) and mixing.mix(df.limit(0)).count() == 0
    none = mixing.mix(spark.createDataFrame([(None, None, None, None)] * 2 + [(1, "", "x", "y")], "doc_id long, text string, source string, lang string")).collect()
    assert [(r.n_tokens, r.topic) for r in none] == [(0, "d")] * 3


def test_mixing_of_the_tables_meets_its_marginals(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows, rates = mixing.mix(docs).collect(), mixing.cell_rates(mixing._rows(docs, "doc_id", "text")).collect()
    for d in mixing.DIMS:
        kept, _ = kept_shares(rows, d)
        assert abs(sum(kept.values()) - mixing.RATE) < 2e-3
        for v, t in {r[d]: r["target_" + d] for r in rates}.items():
            assert abs(kept[v] - t) <= 0.01 * t


def test_mixing_to_stated_targets_lowers_the_rate(spark):
    rows = [(i, "some words here are written", "s1" if i % 10 else "s2", "en", None) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")
    topic = mixing.F.lit("t")
    out = mixing.mix(df, topic=topic, targets={"source": {"s1": 0.5, "s2": 0.5}, "lang": {"en": 1.0}, "topic": {"t": 1.0}}).collect()
    kept, own = kept_shares(out, "source")
    assert abs(kept["s2"] - 0.95 * own["s2"]) < 1e-3 and abs(kept["s1"] + kept["s2"] - 0.8) < 2e-3  # s2 cannot give half


def test_html_extraction():
    page = """<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><div class="ad">Buy the best of the things</div><article><h1>A &amp; B</h1><p><b>First   &eacute;<br><p>Second
    line</p><div class="comments"><p>I like it</p></div></article><footer>&copy; x</footer></body>"""
    assert htmltext.main_text(page) == "A & B\nFirst é\nSecond line"
    assert htmltext.main_text(None) == htmltext.main_text("") == "" and htmltext.main_text("<p>unclosed") == "unclosed"
    assert htmltext.main_text("<script>var t='</p>';</script><style>p{}</style>") == ""


POLISH = "Rzeka płynie przez całą dolinę, a wzdłuż brzegów rosną wierzby, które każdej wiosny zielenią się pierwsze. " * 3
CHINESE = "春天来了，河边的柳树开始发芽，孩子们在草地上放风筝，老人们坐在长椅上晒太阳，谈论着过去的日子和将来的收成，远处的山上还留着一点白雪。" * 2
ENGLISH = "The river runs through the valley and it is known for the willows that stand on both of its banks in the spring. " * 3


@pytest.mark.parametrize("text", [POLISH, CHINESE, ENGLISH])
def test_html_pages_without_an_article(text):
    body = text.strip()
    page = f"""<body><div class="site-header"><a href=/>Home</a></div><ul class=menu><li><a href=/a>First</a><li><a href=/b>Second</a></ul><h1>Title here</h1><p>{body}</p><p>{body}</p>
    <div id="comments"><p>{body}</p></div><div class="left-sidebar"><p>{body[:90]}</p></div><div class="cookie-notice">We use cookies on this site</div><div id=footer>© someone</div>"""
    assert htmltext.main_text(page) == f"Title here\n{body}\n{body}"


def test_html_names_of_elements():
    page = '<article><div class="long-form has-sidebar"><div class="entry-header"><h1>Head</h1></div><header>Byline</header><p>One</p><div class="post-share"><p>Share it</p></div><p data-id="share">Two</p></div></article>'
    assert htmltext.main_text(page) == "Head\nByline\nOne\nTwo"
    bulk = f'<article><h1>Head</h1><div class="widget"><p>{ENGLISH}</p></div><div class="user-comments"><p>{ENGLISH * 9}</p></div></article>'
    assert htmltext.main_text(bulk) == "Head\n" + ENGLISH.strip()  # a cue on what holds most of the article does not count
    assert htmltext.main_text('<div class="header"><p>Name</p></div><main><p>Text</p><aside>By the way</aside><form>Write us</form></main>') == "Text"


def test_html_pages_cut_anywhere():
    page = f"<html><body><nav><a href='/x'>x</a></nav><article><h1>A &amp; B</h1><p class='lead'>{ENGLISH}</p><!-- note --><p>End</p></article></body></html>"
    whole = htmltext.main_text(page)
    for n in range(0, len(page), 7):
        assert htmltext.main_text(page[:n])[:4] in ("", *(whole[:k] for k in range(1, 5)), "A &", "A &a")


def test_html_table(spark):
    rows = spark.createDataFrame([(1, "u", "<article><p>é b</p></article>", "t"), (2, None, None, "t")], "page_id long, url string, html string, text string")
    assert [tuple(r) for r in htmltext.extract_text(rows).collect()] == [(1, "u", "é b", 3), (2, None, "", 0)]
    twice = htmltext.extract_text(rows.unionAll(rows)).collect()
    assert sorted(r.n_chars for r in twice) == [0, 0, 3, 3] and htmltext.extract_text(rows.limit(0)).count() == 0


@pytest.mark.parametrize("op, label", [(quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_classifiers_on_held_out_documents(spark, op, label):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    extra = frame(spark, [None, "", "word " * 50000], 1000000).select(*docs.columns)
    extra = extra.unionAll(extra.selectExpr("CAST(NULL AS long) AS doc_id", *docs.columns[1:]))
    rows = op(docs.unionByName(extra), labels).collect()
    assert len(rows) == docs.count() + 6 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    known = {r.doc_id: r[label] for r in labels.collect()}
    held = [(known[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in known]
    for value in (0, 1):
        hit, said, real = sum(a == b == value for a, b in held), sum(b == value for _, b in held), sum(a == value for a, _ in held)
        print(label, value, "recall", hit / real, "precision", hit / said, "of", real)
        assert hit / real >= 0.88 and hit / said >= 0.88


def test_classifiers_without_labels(spark, texts):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality_scores(frame(spark, texts), none).count() == toxicity.toxicity_scores(frame(spark, texts), none).count() == len(texts)


def test_recordings_are_aligned(spark):
    rng = np.random.default_rng(3)
    base = [rng.normal(0, 0.3, 64).tolist() for _ in range(6)]
    noisy = [(np.array(v) + 0.001).tolist() for v in base[:2]]
    shifted = base[0][8:] + rng.normal(0, 0.3, 8).tolist()
    vectors = spark.createDataFrame(list(enumerate([*base, base[0], *noisy, shifted, None, []])), "vec_id long, embedding array<double>")
    rows = {r.vec_id: r for r in media.align(media.fingerprints(media.render(vectors), "vec_id", "audio"), "vec_id", every=50).collect()}
    assert len(rows) == 12 and rows[6].class_id == 0 and rows[1].class_id == 1
    query, offset, errors = rows[9].matches.split(":")
    assert query == "0" and abs(int(offset) + 2 * 640 / media.HOP) <= 1 and int(errors) <= 200
    assert rows[2].matches == "" and rows[10].n_frames == 0 and rows[10].n_matches == 0


def wav(samples):
    held = media.io.BytesIO()
    with media.wave.open(held, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(media.RATE)
        w.writeframes((np.asarray(samples) * 12000).astype("<i2").tobytes())
    return held.getvalue()


def tune(rng, notes, each=640):
    t = np.arange(each) / media.RATE
    return np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (k / 12) * t) for k in rng.integers(0, 24, notes)])


def test_silence_matches_nothing_and_adds_nothing(spark):
    rng = np.random.default_rng(9)
    a, b = tune(rng, 30), tune(rng, 30)
    still = np.zeros(20000)
    sounds = {0: still[:8000], 1: still, 2: np.r_[still, a], 3: np.r_[a, still], 50: np.r_[still, b], 100: a, 4: np.r_[still, still, tune(rng, 30)], 150: still[:15000]}
    rows = spark.createDataFrame([(k, wav(x)) for k, x in sounds.items()] + [(None, wav(b)), (2, wav(still))], "id long, audio binary")
    out = media.align(media.fingerprints(rows, "id", "audio"), "id").collect()
    got = {(r.id, r.n_frames): [int(m.split(":")[0]) for m in r.matches.split()] for r in out}
    by = lambda k: sorted(x for (i, _), v in got.items() if i == k for x in v)
    assert len(out) == 10 and by(0) == by(1) == by(4) == by(150) == []
    assert by(2) == by(3) == [100] and by(None) == [50]
    assert media.align(media.fingerprints(rows.limit(0), "id", "audio"), "id").count() == 0


def test_recall_on_shifted_and_noisy_recordings():
    """Excerpts at any sample and with noise are found among others; of the 870 other pairs few share OVERLAP frames by chance."""
    rng = np.random.default_rng(10)
    tunes = [tune(rng, 40) for _ in range(30)]
    prints = [media.fingerprint(media.chroma(x)) for x in tunes]
    queries = media._Queries(list(range(30)), [p.astype("<u4").tobytes() for p in prints])
    found = wrong = 0
    for k, x in enumerate(tunes):
        at = int(rng.integers(0, len(x) // 2))
        part = x[at : at + len(x) // 3] + rng.normal(0, 0.05, len(x) // 3)
        got = {q for q, _, _ in queries.match([media.fingerprint(media.chroma(part))])[0]}
        found += k in got
        wrong += len(got - {k})
    assert found >= 27 and wrong <= 0.04 * 870


def test_media_decoding_of_bad_data():
    assert len(media.decode(None)) == len(media.decode(b"no wave")) == 0
    assert len(media.fingerprint(media.chroma(np.zeros(3)))) == 0


def labelled(spark, good, bad):
    """Documents 1 to good + bad, of two kinds that share many words, with their labels (all quality 1 and toxic 0, or the reverse)."""
    rng = np.random.default_rng(8)
    kind = lambda y: " ".join(f"w{i}" for i in rng.integers(0, 40, 12) + (8 if y else 0))
    ys = [1] * good + [0] * bad
    docs = frame(spark, [kind(y) for y in ys], 1)
    return docs, spark.createDataFrame([(k + 1, y, 1 - y) for k, y in enumerate(ys)], "doc_id long, quality int, toxic int")


def test_quality_scores_keep_the_odds_of_capped_classes(spark):
    docs, labels = labelled(spark, 1200, 150)
    rate = lambda rows: np.mean([r.score for r in rows if not r.held_out])
    share = 1200 / 1350
    whole = rate(quality.quality_scores(docs, labels).collect())
    capped = rate(quality.quality_scores(docs, labels, per_class=100).collect())
    assert abs(whole - share) < 0.05 and abs(capped - share) < 0.08


def test_toxicity_cuts_count_the_labels_behind_the_sample():
    v = np.r_[np.arange(20), np.arange(20) + 12.5]
    y, behind = np.repeat([0.0, 1.0], 20), np.array([8.0, 1.0])
    model = toxicity.ToxicityModel([], np.zeros(0))
    model.logits = lambda column: (v, np.zeros(40, np.int64))
    model._calibrate([""] * 40, y, np.ones(40, bool), behind)
    errors = lambda cut: behind[0] * np.sum((v >= cut) & (y == 0)) + behind[1] * np.sum((v < cut) & (y > 0))
    assert all(errors(c) == min(errors(x) for x in [-1, *(v + 0.25)]) for c in model.cuts)


def aligned_somewhere(a, b):
    """Whether some offset has an overlap that is long enough and bits that agree; by brute force."""
    for off in range(-len(b) + 1, len(a)):
        x, y = a[max(0, off) :], b[max(0, -off) :]
        m = min(len(x), len(y))
        if m >= min(media.OVERLAP, len(a), len(b)) and np.unpackbits((x[:m] ^ y[:m]).view(np.uint8)).mean() <= media.ERRORS:
            return True
    return False


def test_recordings_with_held_notes_are_found_as_by_brute_force():
    rng = np.random.default_rng(4)
    held = lambda: np.full(20, 77, np.uint32)
    draw = lambda: rng.integers(0, 1 << 32, 60, dtype=np.uint32)
    music = [draw() for _ in range(5)]
    queries = media._Queries(list(range(5)), [np.r_[held(), x].astype("<u4").tobytes() for x in music])
    flip = lambda x: x ^ np.packbits(rng.random((60, 32)) < 0.05).view(np.uint32)
    found = real = 0
    for k in range(40):
        rec = np.r_[flip(music[k % 5]) if k < 30 else draw(), held()]
        got = {q for q, _, _ in queries.match([rec])[0]}
        want = {q for q in range(5) if aligned_somewhere(rec, queries.prints[q])}
        assert got <= want
        found, real = found + len(got), real + len(want)
    assert real >= 30 and found >= 0.9 * real
