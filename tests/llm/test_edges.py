"""Every operator on nulls, empty and long texts, repeated rows, null ids, clashing names and empty tables; plain restatements of rules."""

import os
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wearpath.llm import alignment, bpe, chat, embeddings, langid, lexical, linededup, packing, quality, simhash, toxicity, urls, warc

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ROWS = [(1, "Some words, you moron."), (1, "Some words, you moron."), (2, None), (3, ""), (None, "Some words, you moron."), (None, None), (4, LONG), (5, " \n\t"), (6, "½ ❤ 漢字\nline\nline")]
#: Names that operators use inside, with other types than theirs.
CLASH = "id string, label string, word int, th int, pos string, lid int, keys int, keep int, fp string, c string, k int, t string, block int, own int, ab int, pairs int, item string, length string, bin string, n int, score string, kind int, payload int, sha1 int, path int, rank string, host int, best int"


def table(spark, rows, schema, clash):
    df = spark.createDataFrame(rows, schema).repartition(3)
    return df.withColumns({c: F.lit(None).cast(k) for c, k in (f.split() for f in CLASH.split(", "))}) if clash else df


def docs_of(spark, clash=False):
    return table(spark, ROWS, "doc_id bigint, text string", clash)


def pages_of(spark, clash=False):
    urls_of = ["https://A.example.org/en/1x?q", None, "no scheme", "http://b.de/", "x://"]
    rows = [(i, urls_of[k % 5], t) for k, (i, t) in enumerate(ROWS)] + [(9, "http://c.com/fr/", f'<a href="http://b.de/x">{LONG}</a>')]
    return table(spark, rows, "page_id bigint, url string, html string", clash)


@pytest.fixture(scope="module")
def operators(spark, tmp_path_factory):
    """Name -> (operator, table, id column, columns that say the same for the same rows)."""
    files = [public_tokenizers.path(f"byte_bpe_50k.{k}") for k in ("json", "tiktoken")]
    vocabulary = bpe.Vocabulary.read(files[1], public_tokenizers.PATTERN)
    encoder = packing.Encoder.read(*files, public_tokenizers.PATTERN)
    both = alignment.Tokenizers.read(files[0], public_tokenizers.path("piece_bpe_32k.model"), files[1], public_tokenizers.PATTERN)
    lexicon = toxicity.Lexicon({"moron": 4.0}, (), 5.0, -3.0)
    lang = spark.createDataFrame([("en" if i % 2 else "de", f"{'the house' if i % 2 else 'das Haus'} {i} " * 9) for i in range(60)], "lang string, text string")
    net = langid.train(lang)
    return {
        "quality": (quality.line_quality, docs_of, "doc_id", None),
        "kept": (lambda d: quality.kept_documents(d).select("doc_id", "text"), docs_of, None, None),
        "urls": (urls.judge_urls, pages_of, "page_id", None),
        "simhash": (simhash.simhash_groups, docs_of, "doc_id", None),
        "dedup": (lambda d: simhash.dedup(d).select("doc_id", "text"), docs_of, None, None),
        "bpe": (lambda d: bpe.round_trip(d, vocabulary), docs_of, "doc_id", None),
        "toxicity": (lambda d: toxicity.score(d, lexicon), docs_of, "doc_id", None),
        "langid": (lambda d: langid.predict(d, net), docs_of, "doc_id", None),
        "recognised": (lambda d: langid.recognised(d, net).select("doc_id", "text"), docs_of, None, None),
        "packing": (lambda d: packing.pack_documents(d, encoder), docs_of, None, ["doc_id", "piece", "start", "length", "ids_crc32"]),
        "lines": (lambda d: linededup.without_repeated_lines(d).select("doc_id", "text"), docs_of, "doc_id", None),
        "alignment": (lambda d: alignment.alignments(d, both), docs_of, "doc_id", None),
        "warc": (lambda p: warc.round_trip(p, os.fspath(tmp_path_factory.mktemp("warc"))), pages_of, "page_id", None),
        "lexical": (lambda d: lexical.search(d, d.select(F.lit(7).alias("item_id"), F.lit("words moron").alias("text")).distinct()), docs_of, None, None),
    }


NAMES = "quality kept urls simhash dedup bpe toxicity langid recognised packing lines alignment warc lexical".split()


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_clashing_names_and_empty_tables(spark, operators, name):
    work, source, key, columns = operators[name]
    rows = lambda df: Counter(map(tuple, df.select(*(columns or df.columns)).collect()))
    found = work(source(spark))
    plain = rows(found)
    assert rows(work(source(spark, clash=True))) == plain
    if key:
        assert Counter(r[0] for r in found.select(key).collect()) == Counter(r[0] for r in source(spark).select(key).collect())
    empty = work(source(spark).where("false"))
    assert empty.columns == found.columns and empty.count() == 0


def test_values_of_odd_rows(spark, operators):
    by = lambda name: {r[0]: r for r in operators[name][0](docs_of(spark)).collect()}
    assert [by("bpe")[i]["n_tokens"] for i in (2, 3)] == [0, 0]
    assert [by("langid")[i]["lang_pred"] for i in (2, 3, 5)] == ["und"] * 3
    score = by("toxicity")
    assert score[1]["score"] >= 0.5 > score[2]["score"] == score[3]["score"]
    sim = operators["simhash"][0](docs_of(spark)).collect()
    assert {r["component_id"] for r in sim if r["fp"] == 0} == {2} and all(r["component_id"] == 1 for r in sim if r["doc_id"] == 1)
    packed = operators["packing"][0](docs_of(spark)).collect()
    assert sorted(r["length"] for r in packed if r["doc_id"] in (2, 3)) == [1, 1]
    assert not any(r["kept"] for r in by("quality").values() if r["doc_id"] != 4)
    page = {r["page_id"]: r for r in operators["warc"][0](pages_of(spark)).collect()}
    assert (page[3]["record_type"], page[2]["record_type"], page[2]["refers_to"], page[2]["payload_bytes"]) == ("response", "revisit", 3, 0)


def test_vectors_with_clashing_names_null_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (None, [1.0, 0.0], 0), (3, None, 0)]
    schema = "vec_id bigint, embedding array<double>, label int"
    plain = embeddings.near_vectors(spark.createDataFrame(rows, schema))
    clash = spark.createDataFrame(rows, schema).withColumns({c: F.lit("x") for c in ("id", "unit", "n", "node", "least", "weight", "p", "group")})
    found = Counter(map(tuple, plain.collect()))
    assert found == Counter(map(tuple, embeddings.near_vectors(clash).collect())) and sum(found.values()) == 5
    assert {r["component_id"] for r in plain.collect() if r["vec_id"] in (1, 2)} == {1}


def test_chats_with_clashing_names_and_a_long_text(spark):
    rows = [(1, 0, "user", LONG * 4), (1, 1, "assistant", "yes"), (2, 0, "user", None)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("parts", chat.text_parts(F.col("text")))
    clash = turns.withColumns({c: F.lit(5) for c in ("id", "formatted", "loss_mask", "attachments", "content", "tokens", "seen")})
    plain = chat.digests(chat.format_chats(turns)).collect()
    assert Counter(plain) == Counter(chat.digests(chat.format_chats(clash)).collect())
    assert {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in plain} == {1: (2, 3), 2: (1, 0)}
    assert next(r["formatted_chars"] for r in plain if r["conv_id"] == 1) > 4 * len(LONG)


def plain_verdict(text):
    """The line rules, said once more: what is left of a text, and whether the document stays."""
    words_of = lambda s: [w for w in re.split(r"[\x20\x09-\x0D]+", s) if w]
    lines = (text or "").split("\n")
    worded = [line for line in lines if words_of(line)]
    short = [len(words_of(s)) <= 6 and s.rstrip()[-1:] not in ".!?:;…。！？\"'”’»)]" and not re.match(r"\s*([-*•·]|\d{1,3}[.)])\s", s) for s in worded]
    left, k = [], -1
    for line in lines:
        words = words_of(line)
        if not words:
            left.append(line)
            continue
        k += 1
        n, letters = len(words), [c for c in line if c.isalpha()]
        bars = sum(w in ("|", "»", ">", "›", "/", "·", "•") for w in words)
        bad = n <= 25 and any(p in line.lower() for p in quality.BOILERPLATE)
        bad |= n > 1 and bars >= 1 and bars >= 0.2 * n
        bad |= sum(bool(set(w) & set("#*$%&|<>")) for w in words) > 0.3 * n
        bad |= n >= 8 and bool(letters) and sum(c.isupper() for c in letters) > 0.7 * len(letters)
        bad |= n >= 20 and len(set(words)) < 0.1 * n
        bad |= not letters
        bad |= short[k] and ((k > 0 and short[k - 1]) or (k + 1 < len(short) and short[k + 1]))
        if not bad:
            left.append(line)
    words = words_of(text or "")
    grams = Counter(zip(words, words[1:], words[2:]))
    again = {i + d for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for d in range(3)}
    chars, stay = len("".join(words)), len("".join(words_of("\n".join(left))))
    return "\n".join(left), len(words) >= 50 and 100 * len(again) <= 50 * len(words) and 1 - stay / chars <= 0.5


def test_kept_equals_plain_rules(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    lines = ["", "  ", "Home", "About us", "Home | Shop | Help", "Read more about it here", "- an item", "12. a step", "# $5 %x", "--- 12 ---", "ab " * 30, "A / B test of the page that went on for long"]
    texts = []
    for _ in range(250):
        own = [rng.choice([lambda: rng.choice(lines), lambda: prose(rng.randint(1, 30)), lambda: prose(12).upper()])() for _ in range(rng.randint(1, 14))]
        texts.append("\n".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: (r["cleaned"], r["kept"]) for r in quality.line_quality(df).collect()}
    assert [found[i] for i in range(len(texts))] == [plain_verdict(t) for t in texts]
    assert 20 < sum(kept for _, kept in found.values()) < 230


def test_bands_find_nearly_all_similar_lines():
    rng = random.Random(7)
    pairs = []
    while len(pairs) < 3000:
        a = " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(rng.randint(8, 40)))
        b = list(a)
        for _ in range(rng.randint(1, 1 + len(a) // 60)):
            b[rng.randrange(len(b))] = "z"
        if linededup.alike(a, "".join(b)):
            pairs.append((a, "".join(b)))
    x, y = (linededup.band_keys([p[k] for p in pairs]) for k in (0, 1))
    assert (x == y).any(axis=1).mean() >= 0.99


def test_line_filter_grows_with_the_lines_and_stops_none_of_them(spark, monkeypatch):
    import xxhash

    assert [linededup.filter_bits(n) for n in (0, 1_000_000, 1 << 22, 10**8, 10**12)] == [1 << 25, 1 << 25, 1 << 26, 1 << 29, 1 << 29]
    monkeypatch.setattr(linededup, "FILTER_BITS", 1 << 15)
    lids = [xxhash.xxh3_128_digest(str(i)) for i in range(20_000)]
    bits = linededup._line_filter(spark.createDataFrame([(bytearray(x),) for x in lids[:10_000]], "lid binary"))
    place = np.array([int.from_bytes(x[:4]) % (8 * len(bits)) for x in lids])
    passed = bits[place >> 3] >> (place & 7) & 1
    assert 8 * len(bits) == 1 << 17 and passed[:10_000].all() and passed[10_000:].mean() < 0.125
    docs = spark.createDataFrame([(1, "one\ntwo"), (2, "two\nthree"), (3, None)], "doc_id bigint, text string")
    wanted = spark.createDataFrame([(bytearray(xxhash.xxh3_128_digest("two")),)], "lid binary")
    assert [r["line"] for r in linededup.line_texts(docs, wanted, "text").collect()] == ["two"]
