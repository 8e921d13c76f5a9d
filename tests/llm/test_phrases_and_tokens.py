import hashlib
import os
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute

from embgauge.llm import chunks, packing, phrases, queries, token_align, words

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, shard string, cell int, ids string, n int, pairs int, words int, rank int"
ODD = " \n\t\r\x0b\x0c　\xa0\x1c\x85'sabABé日\U0001f64212.!,\x00ё"


def table(spark, rows, parts=4):
    """Documents with columns whose names the operators use inside."""
    full = [(i, t, lang, "x", 1, None, 2, 3, 4, 5) for i, t, lang in rows]
    return spark.createDataFrame(full, DOC).repartition(parts)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    vocabulary = ["the", "of", "And", "étude", "of the", "x" * 70, "日本語", "it's", "1,000.5"]
    text = lambda k: "".join(draw.choice(vocabulary) + draw.choice([" "] * 9 + ["  ", "\n", ". ", "\t"]) for _ in range(k))
    out = [text(draw.randint(1, 80)) for _ in range(120)] + [text(30_000)]
    out += ["".join(draw.choice(ODD) for _ in range(draw.randint(0, 60))) for _ in range(200)]
    out += [None, "", " ", "\n", "a<|endoftext|> b <s></s><unk> <0x41>", "x▁y", "no" * 3000, out[0], out[0]]
    langs = ["en", "de", None]
    return [(i, t, langs[i % 3]) for i, t in enumerate(out)] + [(None, out[1], "en"), (3, out[3], "en")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).cache()


@pytest.mark.parametrize("least, top, shards", [(20, 2000, 4), (8, 15, 1), (40, 2000, 9)])
def test_phrases_equal_brute_force(docs, rows, monkeypatch, least, top, shards):
    found = phrases.collocations(docs, least, top, shards)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute.collocations([(lang, t) for _, t, lang in rows], least, top)
    assert sorted(map(tuple, found.collect())) == want and want


def test_long_texts_are_cut_between_pieces(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 50)
    text = "one two, three four five six seven eight. nine ten\n" * 9 + "x " * 60 + ". last"
    batch = pa.RecordBatch.from_arrays([pa.array(["a", text, None, text])], names=["text"])
    steps = [(bytes(d), r.tolist(), b.tolist()) for d, b, r in phrases._steps(batch)]
    assert "".join(d.decode() for d, r, _ in steps if r[0] == 1 and len(r) == 1) == text
    assert all(d[-1:] in b",.\n" for d, r, _ in steps[1:] if r == [1] and not d.endswith(b"last"))
    assert sorted({i for _, r, _ in steps for i in r}) == [0, 1, 2, 3]


def test_phrases_of_nothing(docs, spark):
    assert phrases.collocations(docs.where("false")).count() == 0
    assert phrases.collocations(table(spark, [(1, None, None), (2, " .,", "en")])).count() == 0


def test_bitmaps_hold_their_keys(spark):
    keys = spark.range(-3000, 3000).selectExpr("xxhash64(id) AS key", "id % 4 AS shard").collect()
    rows = spark.createDataFrame([(k.key, k.shard % 4) for k in keys], "gram long, shard long")
    sent = phrases._bitmap(rows.select(phrases._mark(rows["gram"], rows["shard"]).alias("key")))
    gram, shard = np.array([k.key for k in keys]).view(np.uint64), np.array([k.shard % 4 for k in keys])
    assert phrases._held(sent.value, phrases._marked(gram, shard)).all()
    assert phrases._held(sent.value, phrases._marked(gram * np.uint64(3), shard)).mean() < 0.1


@pytest.fixture(scope="module")
def byte_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.byte_bpe_path())


def test_chunks_are_the_text(rows):
    texts = [t or "" for _, t, _ in rows]
    data, bounds = words.text_bytes(pa.array(texts))
    starts = chunks.cuts(data, bounds)
    found = [data[s:e].tobytes().decode() for s, e in zip(starts, [*starts[1:], len(data)])]
    assert "".join(found) == "".join(texts) and "" not in found
    assert set(bounds[:-1][np.diff(bounds) > 0]) <= set(starts)
    ranges = chunks.groups(found, np.array([len(c.encode()) for c in found]))
    assert [i for low, high in ranges for i in range(low, high)] == list(range(len(found)))
    odd = ["a\u3000  b", "a\x85 b", "a\r b\x1c c", "x\u2009y z", "plain text\there"]
    data, bounds = words.text_bytes(pa.array(odd))
    text = lambda s, e: data[s:e].tobytes().decode()
    starts = chunks.cuts(data, bounds).tolist()
    assert [text(s, e) for s, e in zip(starts, [*starts[1:], len(data)])] == [
        "a\u3000  b", "a\x85 b", "a\r b\x1c c", "x\u2009y", " z", "plain", " text", "\there"
    ]


def test_a_full_table_keeps_what_it_met_most(byte_bpe, rows):
    with open(queries.byte_bpe_path(), "rb") as file:
        ids = packing.Ids(file.read())
    ids.table.most = 50
    for _ in range(2):
        for _, text, _ in rows:
            found, bounds = ids(pa.array([text], pa.string()), 1)
            assert found.tolist() == byte_bpe.encode(text or "", add_special_tokens=False).ids + [1]
    assert len(ids.table.hashes) == len(ids.table.uses) == len(ids.ids.bounds) - 1 < 3000


def test_new_chunks_are_encoded_in_few_calls(byte_bpe, monkeypatch):
    with open(queries.byte_bpe_path(), "rb") as file:
        ids = packing.Ids(file.read())
    calls, batch = [], ids.bpe.ids
    monkeypatch.setattr(chunks, "AT_ONCE", 1 << 12)
    monkeypatch.setattr(ids.bpe, "ids", lambda texts: calls.append(len(texts)) or batch(texts))
    monkeypatch.setattr(ids.bpe, "encode", lambda text: pytest.fail("a call for one string"))
    texts = [f"w{i} <|endoftext|> \u00e9t\u00e9{i}\u3000 x{'y' * (i % 700)}{' ' * (i % 3)}" for i in range(300)] + ["", None, " "]
    found, bounds = ids(pa.array(texts, pa.string()), 1)
    want = [byte_bpe.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    assert [found[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
    assert len(calls) == 1 < calls[0]


@pytest.mark.parametrize("window, shortest, step", [(2048, 256, 32768), (64, 8, 128), (16, 16, 16)])
def test_packing_is_whole_and_full(docs, rows, byte_bpe, window, shortest, step):
    found = packing.pack(docs, queries.byte_bpe_path(), window=window, shortest=shortest, step_tokens=step, with_ids=True).collect()
    want = Counter((i, *byte_bpe.encode(t or "", add_special_tokens=False).ids, 1) for i, t, _ in rows)
    pieces = defaultdict(list)
    for r in found:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r.ids))
        pieces[r.id].append(r)
    for i, own in pieces.items():
        # rows that share an id are told apart by putting their pieces together in every order that fits
        texts = [k[1:] for k in want for _ in range(want[k]) if k[0] == i]
        assert sum(r.length for r in own) == sum(map(len, texts))
        for r in own:
            assert any(len(t) == r.doc_tokens and t[r.start : r.start + r.length] == tuple(r.ids) for t in texts)
        if len(texts) == 1:
            own.sort(key=lambda r: r.start)
            assert sum((r.ids for r in own), []) == list(texts[0])
    assert sum(r.length for r in found) == sum((len(k) - 1) * c for k, c in want.items())
    by_sequence, by_group = defaultdict(list), defaultdict(set)
    for r in found:
        by_sequence[r.sequence_id].append(r)
        by_group[r.step_group].add((r.sequence_id, r.sequence_tokens))
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        size = sum(r.length for r in own)
        assert size == own[0].sequence_tokens and size <= window and size & (size - 1) == 0
    for own in by_group.values():
        assert len({size for _, size in own}) == 1 and sum(size for _, size in own) <= max(step, window)
    short = [g for g in by_group.values() if sum(size for _, size in g) < step]
    assert len(short) <= 4 * (window.bit_length() + 1)


def test_packing_cuts_each_window_once(docs):
    found = packing.pack(docs, queries.byte_bpe_path()).where("doc_tokens <= 2048").collect()
    cut, windows = {(r.id, r.start) for r in found if r.start}, {r.sequence_id for r in found}
    assert len(cut) <= len(windows)


def test_packing_of_nothing_and_of_ends(spark, docs):
    assert packing.pack(docs.where("false"), queries.byte_bpe_path()).count() == 0
    (row,) = packing.pack(table(spark, [(7, None, "en")]), queries.byte_bpe_path(), with_ids=True).collect()
    assert (row.id, row.start, row.length, row.ids, row.doc_tokens, row.sequence_tokens) == (7, 0, 1, [1], 1, 1)
    with pytest.raises(ValueError):
        packing.pack(docs, queries.byte_bpe_path(), window=1000)


def plain_alignment(spelled, byte_bpe, pieces, text):
    """``(n_a, n_b, groups, links)`` of one text, or None."""
    if not text:
        return None
    a, b = byte_bpe.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
    ends = []
    for side, ids in zip(spelled, (a, b)):
        if b"".join(side[i] for i in ids) != (" " + text).encode():
            return None
        at = [0]
        for i in ids:
            at.append(at[-1] + len(side[i]))
        ends.append(at)
    links = [
        (a[i], b[j])
        for i in range(len(a))
        for j in range(len(b))
        if ends[0][i] < ends[1][j + 1] and ends[1][j] < ends[0][i + 1]
    ]
    both = sorted(set(ends[0][1:]) & set(ends[1][1:]))
    groups, low = [], 0
    for high in both:
        own = [[str(x) for x, e in zip(ids, at[1:]) if low < e <= high] for ids, at in zip((a, b), ends)]
        groups.append("|".join(",".join(x) for x in own))
        low = high
    return len(a), len(b), groups, links


def test_alignment_equals_brute_force(spark, docs, rows, byte_bpe):
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    byte_bpe.encode_special_tokens = True
    with open(queries.byte_bpe_path(), "rb") as a, open(queries.model_path(), "rb") as b:
        aligner = token_align.Aligner(a.read(), b.read())
    spelled = aligner.a.spelled, aligner.b.spelled
    small = [r for r in rows if r[1] is None or len(r[1]) < 3000]
    want = [(i, plain_alignment(spelled, byte_bpe, pieces, t)) for i, t, _ in small]
    byte_bpe.encode_special_tokens = False
    count = Counter(link for _, w in want if w for link in w[3])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    expected = []
    for i, w in want:
        if w is None:
            expected.append((i, 0, 0, 0, 0, "", 0, 0))
            continue
        digest = hashlib.sha256(";".join(w[2]).encode()).hexdigest()
        sums = sum(count[x] == best[x[1]] for x in w[3]), sum(count[x] for x in w[3])
        expected.append((i, w[0], w[1], len(w[2]), len(w[3]), digest, *sums))
    key = lambda r: tuple(str(x) for x in r)
    frame = table(spark, small)
    for most in (token_align.SENT_PAIRS, 3):
        found = token_align.align(frame, queries.byte_bpe_path(), queries.model_path(), sent_pairs=most)
        got = found.select("id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum").collect()
        assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)
        assert token_align.align(frame.where("false"), queries.byte_bpe_path(), queries.model_path(), sent_pairs=most).count() == 0
    pairs = token_align.pair_counts(frame, queries.byte_bpe_path(), queries.model_path())
    assert {(r.a, r.b): r.n for r in pairs.collect()} == dict(count)
    assert sum(w is None for _, w in want) >= 3 and any(",".join(w[2]).count(",") for _, w in want if w)


def test_offsets_are_refined_inside_characters():
    # a character of three bytes in two tokens: the libraries give both the whole character
    ends = token_align._ends(np.array([0, 1, 2]), np.array([[0, 1], [1, 2], [1, 2]]), np.array([1, 2, 1]), np.array([0, 1, 4]))
    assert ends.tolist() == [1, 3, 4]
