"""The training-data operators on small tables, against brute force, round trips and held-out rows."""

import base64
import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearpath.llm import bpe, chat, embeddings, graph, langid, linededup, packing, quality, simhash, toxicity, urls

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names operators use inside.
CLASH = "doc_id bigint, text string, id bigint, th bigint, keep bigint, fp bigint, dropped string, n_chars int"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], DOCS)


def clashing(spark, texts):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, "x", 5) for i, t in enumerate(texts)], CLASH)


def sentence(rng, n=60):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(n)) + "."


def roots(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


ODD = [None, "", " \n\t", "a", "a", LONG, "Ünï ❤ 漢字", "x" * 50_000, "line\nline\nline"]


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(300, 340)] + [(400, 400)]
    found = dict(graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    want = roots(401, links)
    assert found == {x: want[x] for a, b in links if a != b for x in (a, b)}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("hub", [50_000, 5])
def test_components_of_paths_and_hubs(spark, monkeypatch, hub):
    monkeypatch.setattr(graph, "HUB", hub)
    rng = random.Random(hub)
    names = list(range(6000))
    rng.shuffle(names)
    path = [(names[i], names[i + 1]) for i in range(2500)]
    star = [(names[3000], names[i]) for i in range(3001, 4500)] * 2
    bridge = [(names[3000], names[4600]), (names[4600], names[4700]), (names[4601], names[4602])]
    links = path + star + bridge
    rng.shuffle(links)
    edges = spark.createDataFrame(links, "a bigint, b bigint").repartition(40)
    found = graph.components(edges).collect()
    want = roots(6000, links)
    assert len(found) == len(dict(found)) and dict(found) == {x: want[x] for e in links for x in e}
    text = edges.select(*(F.unhex(F.lpad(F.hex(c), 8, "0")).alias(c) for c in "ab"))
    assert {int.from_bytes(i): int.from_bytes(c) for i, c in graph.components(text).collect()} == dict(found)


def test_crowded_buckets_are_compared_in_blocks(spark, monkeypatch):
    rng = random.Random(21)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(7))) for b in base for _ in range(60)})
    rows = [(0, 0, simhash._signed(f), simhash._signed(f), len(prints)) for f in prints]
    table = spark.createDataFrame(rows, "t int, k bigint, id bigint, c bigint, size bigint").repartition(3)
    links = simhash.compare_blocks(table, ["t", "k"], radius=4, block=17).collect()
    place = {simhash._signed(f): i for i, f in enumerate(prints)}
    want = roots(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    assert roots(len(prints), [(place[a], place[b]) for a, b in links]) == want
    assert all((a ^ b) & (2**64 - 1) and ((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in links)


def test_joined_components(spark):
    rng = random.Random(6)
    first, more = ([(rng.randrange(400), rng.randrange(400)) for _ in range(150)] for _ in range(2))
    found = graph.components(spark.createDataFrame(first, "a bigint, b bigint"))
    joined = graph.joined_components(found, spark.createDataFrame(more, "a bigint, b bigint")).collect()
    want = roots(400, first + more)
    assert len(joined) == len(dict(joined)) and dict(joined) == {x: want[x] for a, b in first + more if a != b for x in (a, b)}
    same = graph.joined_components(found, spark.createDataFrame([], "a bigint, b bigint"))
    assert sorted(same.collect()) == sorted(found.collect())


# 1 quality


def test_quality_counts_by_brute_force(spark):
    texts = [*ODD, "one two three one two three four " * 20, "#a *b $c %d &e |f <g >h\n\n\n#a\n#a"]
    rows = {r["doc_id"]: r for r in quality.line_quality(docs_of(spark, texts)).collect()}
    for i, text in enumerate(texts):
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
        grams = Counter(zip(words, words[1:], words[2:]))
        marked = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(marked))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(marked) > 50 * len(words))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text or "")
    assert rows[8]["n_dup_lines"] == 2 and rows[0]["cleaned"] is None


def test_quality_keeps_prose_and_drops_furniture(spark):
    rng = random.Random(1)
    good = "\n".join(sentence(rng, 30) for _ in range(6))
    menu = good + "\nHome | About | Contact\nWe use cookies to improve this site."
    junk = "\n".join("Home | Shop | Cart | Help | Login | Terms" for _ in range(4)) + "\n" + "\n".join(sentence(rng, 60).upper() for _ in range(3))
    rows = {r["doc_id"]: r for r in quality.line_quality(docs_of(spark, [good, menu, junk])).collect()}
    assert [rows[i]["kept"] for i in range(3)] == [True, True, False]
    assert rows[1]["cleaned"] == good
    kept = quality.kept_documents(clashing(spark, [good, menu, junk, None]))
    assert kept.columns == [f.split()[0] for f in CLASH.split(", ")] and {(r["doc_id"], r["text"], r["n_chars"]) for r in kept.collect()} == {(0, good, len(good)), (1, good, len(good))}


def test_menu_items_apart_by_blank_lines_fail():
    rng = random.Random(4)
    prose = sentence(rng, 60)
    kept, failed = quality.clean_lines(f"Home\n\nAbout\n \t\n\nContact\n\n{prose}\n\nA heading\n\n{prose}", quality.LineRules())
    assert failed == {"punctuation": 3}
    assert [x for x in kept if x.strip()] == [prose, "A heading", prose]


# 2 urls


def test_urls_hosts_paths_and_longest_rule(spark):
    given = [None, "no scheme", "http://A.Org", "https://x.example.org/es/1?q", "http://example.org/en/12#a", "http://b.com/fr/", "http://notorg/x", "x://y://z/k"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(given)], "page_id bigint, url string, html string")
    rows = {r["page_id"]: r for r in urls.judge_urls(pages).collect()}
    assert [rows[i]["host"] for i in range(8)] == ["", "", "a.org", "x.example.org", "example.org", "b.com", "notorg", "y:"]
    assert [rows[i]["path"] for i in range(8)] == ["", "", "", "/es/1", "/en/12", "/fr/", "/x", "//z/k"]
    assert [rows[i]["rule"] for i in range(8)] == [None, None, None, "example.org/es/", "example.org/en/1", "com/fr/", None, None]
    assert urls.judge_urls(pages.where("false")).count() == 0


def test_trust_and_distrust_spread_over_links(spark):
    link = lambda *hs: " ".join(f'<a href="https://{h}/a">x</a>' for h in hs)
    rows = [
        (1, "http://good.org/x", link("friend.net")),
        (2, "http://friend.net/x", ""),
        (3, "http://bad.com/de/1", ""),
        (4, "http://farm.net/x", link("bad.com", "BAD.com")),
        (5, "http://alone.net/x", link("alone.net")),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r["host"]: r for r in urls.judge_urls(pages).collect()}
    verdicts = {h: r["verdict"] for h, r in found.items()}
    assert verdicts == {"good.org": "allow", "friend.net": "allow", "bad.com": "block", "farm.net": "block", "alone.net": "allow"}
    assert found["friend.net"]["trust"] == pytest.approx(0.15 * 0.85)
    assert found["farm.net"]["distrust"] == pytest.approx(0.15 * 0.85)


@pytest.mark.parametrize("referrers", [1, 3, 50])
def test_a_host_that_links_only_to_a_blocked_one_is_blocked_whoever_else_does(spark, referrers):
    rows = [(0, "http://bad.com/de/1", "", 1)] + [(i, f"http://f{i}.net/x", "<a href='http://bad.com/q'>", 1) for i in range(1, referrers + 1)]
    rows += [(90, "http://fair.net/x", "<a href='//bad.com/'>" + "".join(f"<a href='//p{k}.net/'>" for k in range(9)) + "x" * 500_000, 1)]
    pages = spark.createDataFrame(rows + rows[1:2], "page_id bigint, url string, html string, host int")
    found = urls.judge_urls(pages).collect()
    assert len(found) == len(rows) + 1
    assert {r["host"]: r["verdict"] for r in found} == {"bad.com": "block", "fair.net": "allow"} | {f"f{i}.net": "block" for i in range(1, referrers + 1)}
    assert urls.rounds_for(0.85, 1e-4) == 57


def test_ranks_equal_sql_on_a_random_link_graph(spark):
    rng = random.Random(8)
    hosts = [f"h{i}.{('com', 'org', 'net', 'net')[i % 4]}" for i in range(40)]
    rows = [
        (i, f"https://{rng.choice(hosts)}/{rng.choice(['de', 'fr', 'x'])}/{i}", " ".join(f"<a href='//{rng.choice(hosts)}/y'>" for _ in range(rng.randrange(4))))
        for i in range(150)
    ] + [(150, None, None), (151, "http:", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    result = con.execute(urls.judge_sql())
    columns = [d[0] for d in result.description]
    want = sorted(result.fetchall(), key=str)
    assert sorted((tuple(r) for r in urls.judge_urls(df).select(*columns).collect()), key=str) == want
    assert {r[columns.index("verdict")] for r in want if r[columns.index("rule")] is None} == {"allow", "block"}


# 3 simhash


def test_masks_cover_the_radius():
    rng = random.Random(5)
    masks = simhash.covering_masks(4)
    assert len(masks) == 31
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(m & diff == 0 for m in masks)


def test_simhash_components_by_brute_force(spark):
    rng = random.Random(2)
    base = [sentence(rng, 200).split() for _ in range(6)]
    texts = list(ODD)
    for words in base:
        for _ in range(12):
            w = list(words)
            w[rng.randrange(len(w))] = "edit"
            texts.append(" ".join(w))
    prints = [simhash.fingerprint(t.encode() if t else None) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    want = roots(len(texts), links)
    rows = {r["doc_id"]: r for r in simhash.simhash_groups(docs_of(spark, texts)).collect()}
    assert [rows[i]["component_id"] for i in range(len(texts))] == want
    assert [rows[i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    kept = simhash.dedup(clashing(spark, texts))
    assert {r["doc_id"] for r in kept.collect()} == set(want) and kept.columns[2] == "id"
    assert simhash.dedup(docs_of(spark, ["a"]).where("false")).count() == 0


# documents of the pipeline


def test_pipeline_stage_keeps_one_document_of_each_simhash_group(spark, sf_dir):
    rng = random.Random(15)
    w = sentence(rng, 300).split()
    near = [*w]
    near[150] = "other"
    texts = [" ".join(x) for x in (w, near, w, sentence(rng, 300).split())]
    prints = [simhash.fingerprint(t.encode(), 4) for t in texts]
    want = [i for i, r in enumerate(roots(4, [(i, j) for i in range(4) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])) if i == r]
    stage = dict(__import__("corpus_pipeline").STAGES)["simhash_near_dedup"]
    out = stage(spark, clashing(spark, texts), sf_dir)
    assert sorted(r["doc_id"] for r in out.collect()) == want and out.columns == [f.split()[0] for f in CLASH.split(", ")]
    assert 2 not in want and 3 in want
    assert stage(spark, docs_of(spark, ["a"]).where("false"), sf_dir).count() == 0


def test_a_stage_deletes_the_tables_of_the_one_before(spark, tmp_path):
    from wearpath.llm import common

    @common.stage
    def work(session, docs, _):
        return common.stored(docs, "scope")

    first = work(spark, docs_of(spark, ["a"]), "")
    assert first.count() == 1 and len(common._BEFORE) == 1
    path = common._BEFORE[0][1]
    assert os.path.exists(path)
    assert work(spark, docs_of(spark, ["b"]), "").count() == 1
    assert not os.path.exists(path) and len(common._BEFORE) == 1


def test_batches_are_sliced_without_touching_the_session(spark):
    from wearpath.llm import common

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows])], names=["n"])

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert common.map_batches(spark.range(1200, numPartitions=1), sizes, "n bigint").agg(F.max("n")).first()[0] == common.BATCH_ROWS
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


# 4 byte BPE


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_exact(vocabulary):
    whole = vocabulary.whole
    assert sorted(whole.slots) == list(range(len(whole.keys)))
    assert all(whole.get(k) == i for i, k in enumerate(whole.keys))
    assert whole.get(b"no such token here") == -1
    assert whole.get_all([*whole.keys, b"no such token here", b""]) == [*range(len(whole.keys)), -1, -1]


def test_bpe_equals_reference_and_decodes(spark, vocabulary, reference, sf_dir):
    real = [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts = [*ODD, "<|endoftext|> it's 12345   \n\n x", *real]
    rows = {r["doc_id"]: r for r in bpe.round_trip(docs_of(spark, texts), vocabulary).collect()}
    for i, t in enumerate(texts):
        ids = reference.encode_ordinary(t or "")
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs_of(spark, ODD), vocabulary), vocabulary)
    assert {r["doc_id"]: bytes(r["text"]).decode() for r in back.collect()} == {i: t or "" for i, t in enumerate(ODD)}
    assert bpe.round_trip(docs_of(spark, ["a"]).where("false"), vocabulary).count() == 0


def test_long_text_goes_in_slices(vocabulary, reference, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_TOKENS", 50)
    text = "Slices don't change   what comes out, 123. " * 40
    slices = next(iter(vocabulary.encode([text])))
    assert [i for s in slices for i in s] == reference.encode_ordinary(text)


# 5 embeddings


def test_vectors_by_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16))
    x[100:200] = x[:100] + rng.normal(size=(100, 16)) * 0.05
    x[200:240] = x[0]
    x[240:260] = 3 * x[1]
    rows = [(i, [float(v) for v in x[i]], int(i % 3) if i < 200 else 0) for i in range(300)]
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0), (303, [None] * 16, 0), (304, rows[0][1], None), (305, [1.0, 0.0], 0), (306, [], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("id", F.lit("clash"))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows[:300]])
    near = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    want = roots(307, zip(*np.nonzero(near)))
    for interval in (7, 1000):
        found = {r["vec_id"]: r for r in embeddings.near_vectors(df, interval=interval).collect()}
        assert [found[i]["n_links"] for i in range(300)] == near.sum(1).tolist()
        assert [found[i]["component_id"] for i in range(307)] == want
        assert all(found[i]["n_links"] == 0 and found[i]["kept"] for i in range(300, 307))
    assert embeddings.near_vectors(df.where("false")).count() == 0


# 6 toxicity


def test_folding_and_exceptions():
    innocent = ("trash can", "trash bag", "trash cans", "take out the trash")
    lex = toxicity.Lexicon({"idiot": 4.0, "trash": 3.0}, innocent, slope=5.0, offset=-3.0)
    import time

    start = time.perf_counter()
    assert lex.hits(toxicity.fold("trash can idiot " * 60_000 + "trash"))[-1][2] == 3.0
    assert time.perf_counter() - start < 5
    rng = random.Random(3)
    for _ in range(50):
        words = rng.choices(["trash", "can", "idiot", "idiots", "bag", "take", "out", "the", "xtrash"], k=40)
        text = rng.choice([" ", "  ", ", "]).join(words)
        phrases = [m.span() for e in map(toxicity.fold, lex.exceptions) for m in re.finditer(rf"(?<![^\W_])(?={re.escape(e)}(?![^\W_]))", text)]
        covered = [(a, a + len(e)) for e in map(toxicity.fold, lex.exceptions) for m in re.finditer(rf"(?<![^\W_])(?={re.escape(e)}(?![^\W_]))", text) for a in [m.start()]]
        naive = [(m.start(), m.end(), w) for word, w in lex.weights.items() for m in re.finditer(rf"(?<![^\W_]){word}(?![^\W_])", text)]
        naive = sorted(n for n in naive if not any(a <= n[0] and n[1] <= b for a, b in covered))
        assert lex.hits(text) == naive and len(phrases) == len(covered)
    for text in ("You IDIOT", "you 1d10t!", "іdіоt", "ｉｄｉｏｔ", "id\u200biot", "such trash"):
        assert lex.score(text) > 0.5, text
    for text in (None, "", "idiotic idioms", "put it in the trash can", "10 3 1337", "kind words"):
        assert lex.score(text) < 0.5, text


def test_lexicon_is_learned(spark):
    rng = random.Random(8)
    texts = [sentence(rng, 40) + (" what a moron you are" if i % 4 == 0 else "") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(1, None), (None, 1)], "doc_id bigint, toxic int")
    docs = docs_of(spark, texts + [None, ""])
    lexicon = toxicity.learn(docs, labels)
    assert "moron" in lexicon.weights
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, lexicon).collect()}
    assert all((scores[i] >= 0.5) == (i % 4 == 0) for i in range(300, 400)) and scores[400] < 0.5 and scores[401] < 0.5
    empty = toxicity.learn(docs, labels.where("false"))
    assert toxicity.score(docs, empty).where("score >= 0.5").count() == 0


def test_phrases_that_clean_texts_share_are_excused(spark):
    rng = random.Random(9)
    tails = [" you are trash", " put it in the trash can", " what trash you write", ""]
    kinds = [0 if i % 4 == 0 else 2 if i % 4 == 2 else 1 if i % 36 == 1 else 3 for i in range(600)]
    docs = docs_of(spark, [sentence(rng, 40) + tails[k] for k in kinds])
    labels = spark.createDataFrame([(i, int(kinds[i] in (0, 2))) for i in range(450)], "doc_id bigint, toxic int")
    lexicon = toxicity.learn(docs, labels)
    assert "trash" in lexicon.weights and {"the trash", "trash can"} <= set(lexicon.exceptions)
    assert not {"are trash", "what trash", "trash you"} & set(lexicon.exceptions)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, lexicon).collect()}
    assert all((scores[i] >= 0.5) == (kinds[i] in (0, 2)) for i in range(450, 600))
    assert toxicity.Lexicon({"trash": 3.0}).phrases("old trash, new  trash trash can") == {"old trash", "trash trash", "trash can"}


# 7 language


def test_training_windows_come_from_whole_texts_and_all_languages(spark, monkeypatch):
    rng = random.Random(4)
    common = [(i, "en", sentence(rng, 200)) for i in range(300)]
    hot = [(None, "en", "same words again and again " * 30)] * 300
    rare = [(1000, "xx", "".join(chr(rng.randint(0x430, 0x44F)) for _ in range(3000)))]
    rows = spark.createDataFrame([*common, *hot, *rare, (7, None, "x"), (8, "en", None), (9, "en", "")], "doc_id bigint, lang string, text string")
    seen = []
    monkeypatch.setattr(langid.ByteConvNet, "fit", lambda self, x, y, weight, **_: seen.append((x, y, weight)))
    net = langid.train(rows, sample=400)
    (x, y, weight), whole = seen[0], langid.windows(np.frombuffer(rare[0][2].encode(), np.uint8))
    assert net.languages == ["en", "xx"] and {bytes(w) for w in x[y == 1]} == {bytes(w) for w in whole}
    assert 100 < (y == 0).sum() < 320 and len({bytes(w) for w in x}) == len(x)
    assert np.isclose(weight[y == 0].sum(), weight[y == 1].sum())



def test_windows_hold_every_byte():
    data = np.arange(1, 600, dtype=np.uint16).astype(np.uint8)
    x = langid.windows(data, 256)
    assert x.shape == (3, 256) and (x[0] == data[:256]).all() and (x[1] == data[253:509]).all() and (x[2, :93] == data[506:]).all() and not x[2, 93:].any()
    for n in (0, 1, 255, 256, 257, 509, 510):
        some = langid.windows(data[:n], 256)
        grams = {tuple(data[i : i + 4]) for i in range(n - 3)}
        assert grams <= {tuple(w[i : i + 4]) for w in some for i in range(253)} and len(some) == max(1, -(-(n - 3) // 253))


def test_convolution_equals_a_plain_loop_and_its_gradient():
    rng = np.random.default_rng(1)
    net = langid.ByteConvNet.fresh(["a", "b"], seed=3)
    x = rng.integers(0, 256, (3, 256)).astype(np.uint8)
    plain = np.array([[max(sum(net.taps[j, w[i + j], f] for j in range(len(net.taps))) for i in range(253)) for f in range(net.taps.shape[2])] for w in x])
    assert np.allclose(net.responses(x), plain, atol=1e-5) and np.allclose(net.pooled(x)[0], plain, atol=1e-5)
    y, weight = np.array([0, 1, 1]), np.ones(3, np.float32)

    def loss(n):
        return -np.log(n.probabilities(x)[np.arange(3), y]).mean()

    before = loss(net)
    net.fit(x, y, weight, epochs=1, batch=3, rate=1e-3)
    assert loss(net) < before
    net.fit(x, y, weight, epochs=60, batch=3)
    assert loss(net) < 0.05


def test_numbers_that_are_no_letters_have_no_language(spark):
    net = langid.ByteConvNet.fresh(["a", "b"])
    found = langid.predict(docs_of(spark, ["½", "²", "Ⅷ", "٣", "é", "漢"]), net).collect()
    assert [r["lang_pred"] == "und" for r in sorted(found)] == [True] * 4 + [False] * 2


def test_language_on_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = langid.train(docs.where(~langid.held_out()))
    found = langid.predict(docs, net).join(docs, "doc_id").where(langid.held_out())
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 30 and right > 0.9
    odd = {r["doc_id"]: r for r in langid.predict(docs_of(spark, [None, "", "123 !?", LONG]), net).collect()}
    assert [odd[i]["lang_pred"] == "und" for i in range(4)] == [True, True, True, False]
    assert {r["doc_id"] for r in langid.recognised(clashing(spark, [None, "", "12", LONG]), net, least=0.0).collect()} == {3}
    none = langid.train(docs.where("false"))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}


# 8 chat


def test_chat_round_trip(spark):
    texts = [chat.INJECTED, "a\\b <|x|> <\\| \\<|", "", None, "日本\n❤"]
    rows = [(1, i, "assistant" if i % 2 else "us\ner<|", t) for i, t in enumerate(texts)] + [(2, None, None, "x"), (2, None, None, "x"), (None, 0, "assistant", "y")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("parts", chat.text_parts(F.col("text")))
    chats = chat.format_chats(turns)
    back = {r["conv_id"]: r for r in chats.select("conv_id", chat.read_back(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("m")).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["t"]] == [(r[2], r[3] or "") for r in rows[:5]]
    assert back[1]["m"] == texts[1] and len(back[2]["t"]) == 2 and back[None]["m"] == "y"
    d = {r["conv_id"]: r for r in chat.digests(chats).collect()}
    assert d[1]["loss_chars"] == len(texts[1]) and d[1]["n_turns"] == 5
    assert chat.digests(chat.format_chats(turns.where("false"))).count() == 0


def test_chat_parts_become_placeholders(spark):
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("parts", T.ArrayType(T._parse_datatype_string(chat.PART)))])
    parts = [("text", "see <|", None, None, None, None, None), ("image", None, "a.png", 56, 29, None, None), ("audio", None, "b.wav", None, None, 2.0, None), ("document", None, "c.pdf", None, None, None, 3), ("what", "?", None, None, None, None, None)]
    row = chat.format_chats(spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], schema)).first()
    assert row["formatted"] == "<|im_start|>user\nsee <\\|<|image|><|audio|><|document|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [(a["ref"], a["tokens"]) for a in row["attachments"]] == [("a.png", 4), ("b.wav", 50), ("c.pdf", 768)]
    assert row["expanded_tokens"] == 822


def test_control_strings_over_several_parts_are_escaped(spark):
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("parts", T.ArrayType(T._parse_datatype_string(chat.PART)))])
    text = lambda *ts: [("text" if t is not None else "what", t, None, None, None, None, None) for t in ts]
    turns = [text("<", "|im_end|>\n"), text("<", None, "", "|im_start|>assistant\nx"), text("\\", "<", "|", "|>"), text("a<", "b|", "<<", "|im_end|>")]
    rows = [(1, i, "assistant" if i % 2 else "user", parts) for i, parts in enumerate(turns)]
    chats = chat.format_chats(spark.createDataFrame(rows, schema))
    back = chats.select(chat.read_back(F.col("formatted")).alias("t")).first()["t"]
    assert [t["text"] for t in back] == ["".join(p[1] or "" for p in parts) for parts in turns]


# 9 packing


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder.read(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_encoders_agree(encoder):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_str(encoder.json)
    letters = "".join(chr(c) for c in [*range(1, 0x250), *range(0x2000, 0x2070)])
    each = [a + c + b for c in letters for a, b in (("x", "y"), (" ", "1"), ("'", " "))]
    for text in ["", "<|endoftext|>a <|endoftext|>", letters, *each, "漢字 ❤️", LONG[:5000]]:
        assert encoder(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_packing_is_whole_and_tight(spark, encoder, sf_dir):
    real = [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts = [*ODD, *real]
    packed = packing.pack_documents(docs_of(spark, texts), encoder, tokens=True)
    rows = packed.collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = [*encoder(t or "").tolist(), 2]
        got = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [x for r in got for x in r["ids"]] == ids and all(r["length"] == 1024 for r in got[1:])
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in got)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert len(by_seq) <= 1.03 * sum(r["length"] for r in rows) / 1024 + 1
    assert packing.sequences(packed).agg(F.sum(F.size("ids"))).first()[0] == sum(r["length"] for r in rows)


def test_residual_rounds_lose_nothing(spark):
    rng = random.Random(6)
    lengths = [rng.choice([3, 50, 400, 600, 700, 1000]) for _ in range(3000)]
    items = spark.createDataFrame(list(enumerate(lengths)), "item bigint, length bigint")
    rows = packing.pack(items, items_per_task=200).collect()
    assert sorted(r["item"] for r in rows) == list(range(3000))
    bins = {}
    for r in rows:
        bins.setdefault(r["bin"], []).append((r["offset"], lengths[r["item"]]))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    one = packing.best_fit(np.array(lengths), 1024)
    assert len(bins) <= 1.05 * (one.max() + 1)
    assert packing.pack(items.where("false")).count() == 0


def test_tree_packs_as_one_pass_does(spark):
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 1024, 30_000)
    items = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "item bigint, length bigint")
    tree = packing.pack(items, items_per_task=4000).select("bin").distinct().count()
    once = int(packing.best_fit(lengths, 1024).max()) + 1
    assert -(-int(lengths.sum()) // 1024) <= tree <= once * 1.01  # bins travel as items, which costs some half per cent here


def test_best_fit_equals_a_plain_one():
    rng = random.Random(12)
    for _ in range(30):
        lengths = np.array([rng.randint(1, 40) for _ in range(rng.randint(1, 60))])
        rooms, want = [], np.empty(len(lengths), int)
        for i in np.argsort(-lengths, kind="stable"):
            fits = [r for r in rooms if r >= lengths[i]]
            if fits:
                rooms[rooms.index(min(fits))] -= lengths[i]
            else:
                rooms.append(40 - lengths[i])
        bins = packing.best_fit(lengths, 40)
        assert sorted(40 - np.bincount(bins, weights=lengths).astype(int)) == sorted(rooms)


# 10 lines


def brute_lines(texts):
    lines = list(dict.fromkeys(line for t in texts for line in (t or "").split("\n") if line.strip()))
    sets = [linededup.shingles(x) for x in lines]
    links = [(i, j) for i in range(len(lines)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return {line: r for line, r in zip(lines, roots(len(lines), links))}


def test_line_dedup_by_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    base = [sentence(rng, 30) for _ in range(40)]
    texts = [*ODD[:-1]]
    for _ in range(60):
        lines = [rng.choice(base) for _ in range(4)] + [""]
        k = rng.randrange(4)
        lines[k] = lines[k].replace(rng.choice("abcdef"), "z", 1)
        texts.append("\n".join(lines))
    comp, seen, want = brute_lines(texts), set(), {}
    found = {r["id"]: r for r in linededup.repeated_lines(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        for p, line in enumerate((t or "").split("\n")):
            if line.strip():
                if comp[line] in seen:
                    want.setdefault(i, []).append(p)
                seen.add(comp[line])
    assert {i: r["dropped"] for i, r in found.items()} == want
    monkeypatch.setattr(linededup, "BLOCK", 3)
    monkeypatch.setattr(linededup, "similar", lambda pairs, texts: pairs.where("false"))  # all work is left to the blocks
    again = {r["id"]: r["dropped"] for r in linededup.repeated_lines(docs_of(spark, texts)).collect()}
    assert again == want


def test_lines_leave_whole_documents(spark):
    texts = ["Same line here, again.\nOwn first line of text.", "Same line here, again.\n\nOther words stand in this one.", None, "Same line here, again."]
    out = linededup.without_repeated_lines(clashing(spark, texts))
    rows = {r["doc_id"]: r for r in out.collect()}
    assert [rows[i]["text"] for i in range(4)] == [texts[0], "\nOther words stand in this one.", None, ""]
    assert rows[3]["n_chars"] == 0 and rows[3]["dropped"] == "x"
    assert linededup.without_repeated_lines(clashing(spark, texts).where("false")).count() == 0


def test_alike_pairs_are_those_of_the_sets():
    rng = random.Random(12)
    lines = [sentence(rng, 20) for _ in range(40)]
    lines += [x.replace("a", "b", rng.randint(0, 4)) for x in lines] + ["ab", "AB", "", "ab" + "\0" * 6, "abcdefg", "abcdefgh", "x\ud800abcdefgh"]
    for more in ([], ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(60)) for _ in range(60)]):  # small and large alphabets
        all_lines = lines + more + [x[:-2] + "zz" for x in more]
        n = len(all_lines)
        x, y = (np.array(v) for v in zip(*((i, j) for i in range(n) for j in range(i))))
        found = linededup.alike_pairs(all_lines, x, y)
        assert [bool(k) for k in found] == [linededup.alike(all_lines[i], all_lines[j]) for i, j in zip(x, y)]
    assert len(linededup.alike_pairs([], np.array([], int), np.array([], int))) == 0


def test_keys_of_one_line_are_gone_before_the_window(spark):
    """All rows that share a key with another id stay, however the batches cut a run; most others go."""
    name = lambda i: i.to_bytes(16, "big")
    rows = [(name(i), i) for i in range(30_000)]  # keys that occur once
    rows += [(name(7), 40_000)] * 300  # one line's copies
    rows += [(name(i % 50), 50_000) for i in range(25_000)]  # a hot key over several batches
    rows += [(name(i), 60_000 + i // 2) for i in range(2_000)] * 2
    found = linededup.repeated_keys(spark.createDataFrame(rows, "id binary, key bigint")).collect()
    kept = {(bytes(r["id"]), r["key"]) for r in found}
    wanted = {(name(i), 50_000) for i in range(50)} | {(name(i), 60_000 + i // 2) for i in range(2_000)}
    assert wanted <= kept <= {(i, k) for i, k in rows}
    assert len(found) < 3_000


def test_arrays_of_keys_are_packed_by_parts(spark, monkeypatch):
    """Keys come as arrays, null and empty ones too; a part with too many rows goes on in pieces that keep every key."""
    name = lambda i: i.to_bytes(16, "big")
    rows = [(name(i), [i, -i - 1, 90_000 + i // 3]) for i in range(3_000)] + [(name(7), [7]), (name(8), []), (name(9), None)]
    shared = {(name(i), 90_000 + i // 3) for i in range(3_000)}
    table = spark.createDataFrame(rows, "id binary, key array<bigint>").repartition(3)
    kept = [(bytes(r["id"]), r["key"]) for r in linededup.repeated_keys(table).collect()]
    assert sorted(kept) == sorted(shared)
    for name_, value in (("PARTS", 2), ("PACKED", 100), ("MOST", 300)):
        monkeypatch.setattr(linededup, name_, value)
    cut = {(bytes(r["id"]), r["key"]) for r in linededup.repeated_keys(table).collect()}
    assert shared <= cut <= {(i, k) for i, keys in rows for k in keys or ()}
    assert linededup.repeated_keys(table.where("false")).count() == 0


def test_sketches_rule_out_no_similar_pair():
    """Most other pairs are ruled out, and lines of more shingles than a sketch has bits too are compared right."""
    rng = np.random.default_rng(8)
    base = ["".join(rng.choice(list("abcdefgh "), n)) for n in [*rng.integers(1, 400, 60), 9_000, 30_000]]
    edited = ["".join(c if rng.random() > rate else "z" for c in line) for line in base for rate in (0.005, 0.015, 0.03)]
    lines = base + edited + [line * 3 for line in base[:10]]
    x, y = (np.array(v) for v in zip(*((i, j) for i in range(len(lines)) for j in range(i))))
    left = linededup._may_be_alike([linededup._normal(line) for line in lines], x, y, 0.8)
    sets = [linededup.shingles(line) for line in lines]
    like = np.array([len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for i, j in zip(x, y)])
    assert like.sum() > 50 and not (like & ~left).any() and left.sum() < 2 * like.sum()
    assert (linededup.alike_pairs(lines, x, y) == like).all()


def test_pairs_are_alike_whatever_the_alphabet():
    """Shingles are numbered by tables, in one sort or line by line, and compared as sets all the same."""
    rng = np.random.default_rng(3)
    for letters in (4, 90, 700, 20_000):
        lines = ["".join(chr(0x4E00 + c) for c in rng.integers(0, letters, n)) for n in rng.integers(1, 120, 60)]
        lines += [line[:-1] + "x" for line in lines] + ["", "ab", "ab  c"]
        x, y = rng.integers(0, len(lines), 300), rng.integers(0, len(lines), 300)
        x[:60], y[:60] = np.arange(60), np.arange(60, 120)
        found = linededup.alike_pairs(lines, x, y)
        assert found.tolist() == [linededup.alike(lines[i], lines[j]) for i, j in zip(x, y)]
