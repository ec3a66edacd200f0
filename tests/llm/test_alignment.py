"""Tokenizer alignment against a plain one of whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from wearpath.llm import alignment

FILES = [public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")]


@pytest.fixture(scope="module")
def both():
    return alignment.Tokenizers.read(*FILES, public_tokenizers.PATTERN)


def plain(texts):
    """n_a, n_b, n_groups, n_links, n_best, count_sum and the digest of each text, from whole encodings and offsets."""
    a_of, b_of = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    a_of.encode_special_tokens = True
    entry, own = {i: t for t, i in a_of.get_vocab().items()}, alignment.byte_alphabet()
    rows = []
    for t in texts:
        a = a_of.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_of.encode(t) if t else []
        in_a = [entry[i].encode() if entry[i] == "<|endoftext|>" else bytes(own[c] for c in entry[i]) for i in a]
        pieces = [b_of.id_to_piece(i) for i in b]
        in_b = [bytes([int(p[3:5], 16)]) if b_of.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
        if not t or not b"".join(in_a) == b"".join(in_b) == b" " + t.encode():
            rows.append([])
            continue
        ends = []
        for ids, parts in ((a, in_a), (b, in_b)):
            at, out = 0, []
            for i, part in zip(ids, parts):
                at += len(part)
                out.append((i, at))
            ends.append(out)
        cuts = sorted({e for _, e in ends[0]} & {e for _, e in ends[1]})
        groups, start = [], 0
        for cut in cuts:
            groups.append([[i for i, e in side if start < e <= cut] for side in ends])
            start = cut
        rows.append(groups)
    count = Counter(pair for groups in rows for pair in {(x, y) for g in groups for x in g[0] for y in g[1]})
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for groups in rows:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((
            sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
            sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return out


def texts_of(rng):
    odd = [
        None, "", " ", "\n", "a", " a", "a ", "a  b", "a \n b", "tab\there", "▁", "a▁b", "<s> </s> <unk> <0x41>", "<|endoftext|>x <|endoftext|>", "0", "½²Ⅷ",
        "Ünï ❤ 漢字", "a　b c", "a  b", "x" * 5000, "x" * 3000 + " " + "y" * 777, "‏שלום עולם", "é é", "line\nline\nline", "\r\n.", "'s 's don't",
        "word " * 3000 + "end", "\x1c a", "a \x85b", "🙂" * 40, "ſ K", "1234567 89,0",
    ]
    pool = ["".join(rng.choices("abcdefgé漢½ ' \n\t-", k=rng.randint(1, 9))) for _ in range(200)] + ["the", "and", "Straße", "don't"]
    return odd + odd[4:8] + [" ".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(150)]


@pytest.mark.parametrize("block", [1 << 25, 200])
def test_equals_a_plain_alignment(spark, both, block):
    texts = texts_of(random.Random(block))
    rows = [(i, t, 1, 2, 3, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, id int, block int, pairs int, own string").repartition(3)
    found = alignment.alignments(docs, both, block_bytes=block)
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    by_id = {r["doc_id"]: tuple(r[c] for c in columns) for r in found.collect()}
    assert [by_id[i] for i in range(len(texts))] == plain(texts)
    assert set(found.columns) == {"doc_id", *columns}


def test_crowded_groups_count_the_same_links(monkeypatch, both):
    texts = [t for t in texts_of(random.Random(9)) if t]
    found = []
    for crowded in (0, 3, 10**9):
        monkeypatch.setattr(alignment, "CROWDED", crowded)
        place, columns = alignment.align(texts, both.open())
        lists = [[dict(zip(*r)) for r in zip(columns["pairs"].to_pylist(), columns["times"].to_pylist())]]
        found.append((place.tolist(), {c: columns[c].to_pylist() for c in columns if c not in ("pairs", "times")}, lists))
    assert found[0] == found[1] == found[2]
    assert [sum(r.values()) for r in found[0][2][0]] == found[0][1]["n_links"]


def test_long_texts_are_aligned_in_pieces(both):
    for text in (t for t in texts_of(random.Random(2)) if t):
        place, columns = alignment.align([text], both.open())
        found = alignment.align_long(text, both.open(), size=5)
        if not len(place):
            assert found is None
            continue
        assert [found[c][0] for c in alignment._COUNTS] == [columns[c][0].as_py() for c in alignment._COUNTS]
        assert found["groups_sha256"] == [hashlib.sha256(columns["groups"][0].as_buffer()).hexdigest()]
        assert dict(zip(found["pairs"][0], found["times"][0])) == dict(zip(columns["pairs"][0].as_py(), columns["times"][0].as_py()))


def test_words_encode_alone_as_in_their_text(both):
    rng = random.Random(4)
    tokenizers = both.open()
    words = ["".join(rng.choices("abcdeé漢½'.,-▁9A❤\n", k=rng.randint(1, 12))).strip() or "w" for _ in range(3000)]
    assert tokenizers.words(words) == tokenizers.encode(words)
    clean = [w for w in words if "▁" not in w]
    alone = tokenizers.words(clean)
    whole = tokenizers.encode([" ".join(clean)])[0]
    assert [i for a, _ in alone for i in a] == whole[0] and [i for _, b in alone for i in b] == whole[1]


def test_repeated_rows_null_ids_and_empty_tables(spark, both):
    docs = spark.createDataFrame([(1, "one text"), (1, "one text"), (None, "one text"), (None, None)], "doc_id bigint, text string")
    found = alignment.alignments(docs, both).collect()
    assert sorted((str(r["doc_id"]), r["n_links"], r["count_sum"]) for r in found) == sorted([("1", 2, 6)] * 2 + [("None", 2, 6), ("None", 0, 0)])
    assert alignment.alignments(docs.where("false"), both).count() == 0
