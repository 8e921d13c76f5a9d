import collections
import hashlib
import os
import random
import re
import sys

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute

from embgauge.llm import ann, collection_bwt, decontaminate, html_extract, line_dedup, ngram_join, piece_bpe, queries
from embgauge.llm import secrets, sharding, shared, suffix_dedup, toxicity
from embgauge.llm import words as shared_words

DOC = "doc_id long, text string, source string, id string, n int, tokens string, at int, value int, p int, list int, v int"
SF = "/root/testdata/sf0.001"


def table(spark, rows, parts=5):
    """Documents with columns whose names the operators use inside."""
    full = [(i, t, s, "x", 1, None, 2, 3, 4, 5, 6) for i, t, s in rows]
    return spark.createDataFrame(full, DOC).repartition(parts)


def written(seed=1, n=60):
    """Random documents with copies, near copies, common lines, ties, blanks, one long text and odd characters."""
    draw = random.Random(seed)
    vocabulary = ["the", "of", "And", "étude", "x" * 30, "日本"] + [f"w{i}" for i in range(300)]
    line = lambda k: " ".join(draw.choice(vocabulary) for _ in range(k))
    common, passage = line(12), line(40)
    out = []
    for i in range(n):
        lines = [line(draw.randint(1, 30)) for _ in range(draw.randint(1, 5))]
        if i % 3 == 0:
            lines.insert(draw.randint(0, len(lines)), common)
        if i % 7 == 0:
            lines.append(passage)
        if i % 4 == 1 and out:
            words = out[draw.randrange(len(out))].split(" ")
            if i % 8 == 1:
                words[draw.randrange(len(words))] = "changed"
            lines = " ".join(words).split("\n")
        out.append("\n".join(lines))
    out += ["", " \t\n ", "one", "one two", "One TWO", "a\x00b\n\n", line(30_000), "🙂 " * 60, common, common.upper()]
    return [(i * 3 + 5, t, None if i % 9 == 0 else f"s{i % 4}") for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def rows():
    return written()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """The documents with a repeated row, a null text and a null id."""
    return table(spark, [*rows, rows[3], (1, None, "s1"), (None, rows[2][1], "s1")]).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_ngram_join_equals_brute_force(docs, rows, empty):
    found = ngram_join.jaccard_components(docs, n=3, num=80, den=100).collect()
    want = brute.classes([(i, t) for i, t, _ in rows], 3, 80, 100)
    by_id = {r.id: (r.n_shingles, r.component_id) for r in found}
    assert {i: by_id[i] for i in want} == want
    assert len(found) == len(rows) + 3 and sum(r.id == rows[3][0] for r in found) == 2
    assert by_id[1] == (0, 1) and by_id[None][1] is None
    assert len({c for _, c in want.values()}) < len(want)
    assert ngram_join.jaccard_components(empty).count() == 0


def test_ngram_join_fetches_tokens_of_few_documents_that_only_share_a_passage(spark, monkeypatch):
    own = lambda i, k: [f"d{i}w{j}" for j in range(k)]
    passage = [[f"p{i}w{j}" for j in range(14)] for i in range(61)]
    texts = [own(i, 40) + passage[i] + passage[i + 1] for i in range(60)]
    for i in range(0, 60, 10):
        texts += [texts[i][:-2] + [f"x{i}"], texts[i][2:] + [f"y{i}"], [f"z{i}", f"z{i}z"] + texts[i][1:-1]]
    rows = [(i, " ".join(t), "s") for i, t in enumerate(texts)]
    counts, stored = [], ngram_join.stored

    def counted(df, **settings):
        out = stored(df, **settings)
        counts.extend([out.count()] if {"tokens", "as_query"} <= set(out.columns) else [])
        return out

    monkeypatch.setattr(ngram_join, "stored", counted)
    # one document a batch, so that no token is seen to repeat and the passages are no rarer than other words
    found = ngram_join.jaccard_components(table(spark, rows, 60), n=3, num=80, den=100)
    assert {r.id: (r.n_shingles, r.component_id) for r in found.collect()} == brute.classes([r[:2] for r in rows], 3, 80, 100)
    assert len(counts) == 1 and counts[0] <= 35


def test_ngram_join_bitmaps_hold_each_row_s_tokens():
    draw = np.random.default_rng(3)
    sizes = [0, 1, 31, 32, 33, 500, 0, 5000]
    tokens, bounds = draw.integers(0, 1 << 64, sum(sizes), dtype=np.uint64), np.append(0, np.cumsum(sizes))
    bits, at = ngram_join._bitmaps(tokens, bounds)
    for i, size in enumerate(sizes):
        words, own = bits[at[i] : at[i + 1]], tokens[bounds[i] : bounds[i + 1]]
        assert 64 * len(words) == max(64, 1 << (2 * size - 1).bit_length() if size else 0)
        want = {int(t) % (64 * len(words)) for t in own}
        assert {64 * j + b for j, w in enumerate(words) for b in range(64) if int(w) >> b & 1} == want


def test_components_of_a_path_a_star_and_loops(spark):
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(1000, 1300)]
    edges = spark.createDataFrame([*path, *star, (5, 5), (101, 100)], "a long, b long")
    found = {r.node: r.component for r in shared.components(edges).collect()}
    assert found == {i: 100 for i in range(100, 141)} | {7: 7} | {i: 7 for i in range(1000, 1300)}
    assert shared.components(edges.where("false")).count() == 0


def test_line_dedup_equals_brute_force(docs, rows, empty):
    found = line_dedup.dedup_lines(docs, n=3)
    assert found.columns == [*docs.columns, "line_count", "lines_removed"]
    by_id = {r.doc_id: r for r in found.collect()}
    want = brute.lines_kept([(i, t) for i, t, _ in rows], n=3)
    assert {i: by_id[i].text for i in want} == want
    assert by_id[1].text is None and by_id[1].line_count == 0
    assert by_id[None].text == rows[2][1] and by_id[None].lines_removed == 0
    assert sum(r.lines_removed for r in by_id.values()) > 20 and found.count() == len(rows) + 3
    assert line_dedup.dedup_lines(empty).count() == 0


@pytest.mark.parametrize("shift", [0, -(1 << 31), 1 << 31, 1 << 40, -(1 << 62)])
def test_first_lines_are_ordered_by_a_long_where_ids_fit(spark, shift):
    rows = [(i + shift, line) for i, line in [(2, 0), (1, 7), (1, 3), (1, (1 << 31) - 1), (3, 1)]]
    frame = spark.createDataFrame(rows, "id long, line int")
    first = line_dedup._first(frame)
    assert frame.agg(*first).collect() == [(1 + shift, 3)]
    assert ("decimal" in str(first[1]).lower()) == (shift not in (0, -(1 << 31)))


def test_new_columns_make_way_for_those_of_the_input(spark):
    text = "one line of seven words in all\nanother line"
    frame = spark.createDataFrame(
        [(1, text, 7, 8, "a", 9, 10), (2, text, 70, 80, "b", 90, 100)],
        "doc_id long, text string, line_count int, Lines_Removed int, kept_lines string, slot int, rewritten int",
    )
    found = line_dedup.dedup_lines(frame)
    assert found.columns == [*frame.columns, "line_count_", "lines_removed_"]
    first, second = sorted(found.collect())
    assert first[1:] == (text, 7, 8, "a", 9, 10, 2, 0) and second[1:] == ("", 70, 80, "b", 90, 100, 2, 2)
    placed = sharding.place(frame.withColumnRenamed("kept_lines", "shard"), ["x", "y"], "doc_id", 11)
    assert placed.columns[-2:] == ["slot_", "shard_"]
    for r in placed.collect():
        at = sharding.digest(str(r.doc_id)) % 11
        assert (r.slot, r.shard) == ((9, "a") if r.doc_id == 1 else (90, "b"))
        assert (r.slot_, r.shard_) == (at, sharding.lookup_table(["x", "y"], 11)[at])


@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 12)), max_size=60))
def test_tokens_of_a_row_once_equal_its_distinct_ones(pairs):
    pairs = sorted(pairs, key=lambda p: p[0])
    row = np.array([r for r, _ in pairs], np.int64)
    tokens = shared_words.mix(np.array([t for _, t in pairs], np.uint64) + np.uint64(1))
    once, bounds = shared_words.once(tokens, row, 7)
    want, ends = shared_words.distinct(tokens, row, 7)
    assert list(bounds) == list(ends)
    for low, high in zip(bounds, bounds[1:]):
        assert sorted(once[low:high]) == list(want[low:high])


def test_decontamination_equals_brute_force(spark, docs, rows, empty):
    long = next(t for _, t, _ in rows if len(t) > 100_000).split()
    items = [(i, " ".join(long[i * 50 : i * 50 + 25])) for i in range(30)]
    items += [(100, "the of"), (101, ""), (102, None), (None, "w1"), (103, "absent words " * 8), (0, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    known = [(i, t) for i, t in items if i is not None and t]
    want = brute.hits([(i, t) for i, t, _ in rows], known)
    for most in (1 << 24, 1500):
        found = {r.id: r for r in decontaminate.contamination(docs, bench, most=most).collect()}
        assert {i: (found[i].n_words, found[i].n_hit, found[i]["items"]) for i in want} == want
        assert found[1].n_words == 0 and not found[1].contaminated
    clean = {i for i, w in want.items() if not w[1]}
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} - {1, None} == clean
    assert decontaminate.contamination(docs, bench.where("false")).where("contaminated").count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0


def test_longest_matches_have_their_places(spark):
    words = [f"t{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, "x y " + " ".join(words[5:30]) + " z")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    (found,) = decontaminate.verbatim_matches(docs, bench).first().matches
    assert (found.start, found.words, found.item, found.item_start) == (2, 25, "9", 5)


def base_spans(text):
    out = []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(assign, text, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for order, kind, pattern, least in ((1, "access", r"AKIA[A-Z0-9]+", 16), (2, "hex", r"[0-9a-f]+", 32)):
        for m in re.finditer(pattern, text):
            if len(m[0]) >= least:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for *_, s in sorted(out))


def test_secret_spans_and_ownership(spark, docs, empty):
    copied, own = "AKIA" + "EXAMPLE0" * 2, "AKIA" + "Z9" * 8
    loose = "Qx7" * 9
    texts = [
        f"é🙂 password = '{'a1' * 6}' {copied}", f"PASSWORD: token : abcdefghi {copied}", f"{copied}{copied}",
        f"{own} AKIA123 {'0f' * 16} {'0f' * 15}", f"api_key=\"{'A/' * 5}\" secret:short", f"see {loose} here", "aa" * 40,
        f"token={'0f' * 20}", "", None, "password=" * 4, f"{'e' * 31}g{'e' * 33}",
    ]
    frame = table(spark, [(i, t, f"s{i}") for i, t in enumerate(texts)] + [(99, f"x {copied}", None)])
    found = {r.id: r for r in secrets.scan(frame).collect()}
    for i, text in enumerate(texts):
        assert found[i].base == base_spans(text or ""), i
    assert found[1].n_copied == 1 and found[1].n_live == 0
    assert found[3].n_live == 2 and found[3].n_access == 1 and found[3].n_hex == 1
    assert found[5].spans == f"owned:4:{4 + len(loose)}" and found[5].base == ""
    more = frame.unionByName(table(spark, [(200, loose, "other")]))
    assert {r.id: r for r in secrets.scan(more).collect()}[5].spans == ""
    assert len(secrets.scan(docs).collect()) == docs.count() and secrets.scan(empty).count() == 0
    plan = secrets.scan(frame)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_a_value_in_many_documents_of_one_source_is_copied(spark):
    loose, example, few = "Qx7" * 9, "AKIA" + "EXAMPLE0" * 2, "AKIA" + "FEWTIMES" * 2
    rows = [(i, f"{loose} {example}", "hot") for i in range(12)] + [(20 + i, f"see {few} {few}", "hot") for i in range(2)]
    found = {r.id: r for r in secrets.scan(table(spark, [*rows, rows[0], (30, "none", "hot")])).collect()}
    for i in range(12):
        assert (found[i].n_copied, found[i].n_live, found[i].n_owned) == (2, 0, 0) and "owned" not in found[i].spans
        assert (found[i].most_owners, found[i].most_repositories) == (1, 12)
    assert (found[20].n_copied, found[20].n_live, found[20].most_repositories) == (0, 2, 2)
    assert (found[30].most_owners, found[30].most_repositories) == (0, 0)
    single = {r.id: r for r in secrets.scan(table(spark, rows), copied_repositories=13).collect()}
    assert (single[0].n_copied, single[0].n_live, single[0].n_owned) == (0, 2, 1)


def test_sharding_is_even_and_moves_little(spark, docs, empty):
    names = [f"n{i}" for i in range(12)]
    full, less = sharding.lookup_table(names, 1009), sharding.lookup_table(names[:-1], 1009)
    held = collections.Counter(full).values()
    assert max(held) - min(held) <= 1 and full == sharding.lookup_table(names[::-1], 1009)
    moved = sum(a != b for a, b in zip(full, less) if a != names[-1])
    assert moved < 0.1 * 1009
    placed = sharding.place(docs, names, "doc_id", 1009)
    for r in placed.collect():
        slot = sharding.digest("" if r.doc_id is None else str(r.doc_id)) % 1009
        assert (r.slot, r.shard) == (slot, full[slot])
    assert placed.count() == docs.count() and sharding.place(empty, names, "doc_id", 1009).count() == 0
    assert set(sharding.lookup_table(["only"], 2)) == {"only"}
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_pieces_equal_the_library(spark, docs, empty):
    import sentencepiece

    path = queries.model_path()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    draw = random.Random(2)
    letters = list("abcdef   \n\t▁éßế​\x00<>/s0x①🙂") + ["  ", "the", "ing", "▁▁", "    "]
    model = piece_bpe.read_model(path)
    parts = sorted(model.usable)
    texts = ["", " ", "   ", "\n", "▁", " a ", "<s></s><unk><0x41>"]
    texts += ["".join(draw.choice(letters) for _ in range(draw.randint(1, 60))) for _ in range(3000)]
    texts += ["".join(draw.choice(parts) for _ in range(draw.randint(1, 9))) for _ in range(3000)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r.id: r.ids for r in piece_bpe.encode(frame, path).collect()}
    want = library.encode(texts, add_eos=True)
    assert all(found[i] == ids for i, ids in enumerate(want))
    back = {r.id: r.text for r in piece_bpe.decode(piece_bpe.encode(frame, path), path).collect()}
    assert all(back[i] == library.decode(ids) for i, ids in enumerate(want))
    columns = ("ids", "n_tokens", "ids_sha256", "decoded_sha256")
    for r in piece_bpe.round_trip(docs, path, columns=columns).collect():
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(r.ids).encode()).hexdigest()
        assert r.id != 1 or r.ids == [2]
    assert piece_bpe.encode(empty, path).count() == 0


def test_words_start_anew_when_the_table_is_full(monkeypatch):
    monkeypatch.setattr(piece_bpe, "MOST_WORDS", 5)
    model = piece_bpe.read_model(queries.model_path())
    small, large = piece_bpe.Encoder(model), piece_bpe.Encoder(model)
    for texts in (["a b c d"], ["e f g h", "a b"], ["", None, "b b b"]):
        a, b = small.encode(texts), large.encode(texts)
        assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])


@pytest.fixture(scope="module")
def vectors(spark):
    draw = np.random.default_rng(0)
    x = draw.normal(size=(800, 12)).round(3)
    x[300:420] = x[300]  # copies
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)]
    odd = [None, [0.0] * 12, [1.0] * 11 + [None], [float("nan")] * 12, [float("inf")] * 12, [1.0] * 5, []]
    rows += [(1000 + i, v, 1) for i, v in enumerate(odd)] + [(None, rows[0][1], 1), rows[7]]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>, list int").repartition(6)


def test_nearest_neighbours(vectors):
    x, frame = vectors
    found = ann.nearest(frame, frame.where("vec_id % 20 = 0"), k=20).collect()
    by_query = collections.defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        by_query[r.query_id].append(r)
    assert set(by_query) == set(range(0, 800, 20))
    hit = 0
    for q, rows in by_query.items():
        scores = x @ x[q]
        assert [r.rank for r in rows] == list(range(1, 21))
        assert all(r.vec_id != q and r.score == pytest.approx(scores[r.vec_id], abs=1e-12) for r in rows)
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        best = [i for i in np.lexsort((np.arange(len(x)), -scores)) if i != q][:20]
        hit += len(set(best) & {r.vec_id for r in rows})
    assert hit / len(found) >= 0.9


def test_few_or_no_vectors(spark, vectors):
    _, frame = vectors
    few = frame.where("vec_id < 4")
    found = ann.nearest(few, few.where("vec_id % 20 = 0")).collect()
    assert sorted(r.vec_id for r in found) == [1, 2, 3]
    assert ann.nearest(frame.where("vec_id >= 1000"), frame).count() == 0
    assert ann.nearest(frame.where("false"), frame.where("false")).count() == 0


def test_scan_gives_up_far_candidates_only():
    draw = np.random.default_rng(1)
    x, q = draw.normal(size=(500, 64)), draw.normal(size=(20, 64))
    at, row = ann.scan(x, q, 10)
    assert len(at) < 20 * 400
    for i in range(20):
        near = np.argsort(((x - q[i]) ** 2).sum(axis=1))[:10]
        assert len(set(near) & set(row[at == i])) >= 9


def test_collection_transform():
    draw = random.Random(3)
    strings = [bytes(draw.choice(b"ab\x00") for _ in range(draw.randint(1, 14))) for _ in range(200)]
    data = np.frombuffer(b"".join(strings), np.uint8)
    lengths = np.array([len(s) for s in strings])
    string, offset, common, symbol = collection_bwt.collection_suffixes(data, np.cumsum(lengths) - lengths, lengths)
    suffix = [strings[i][k:] for i, k in zip(string, offset)]
    assert len(suffix) == sum(lengths) + 200 and suffix == sorted(suffix)
    for j in range(1, len(suffix)):
        assert common[j] == len(os.path.commonprefix([suffix[j - 1], suffix[j]]))
    assert all(s == (strings[i][k - 1] + 1 if k else 0) for i, k, s in zip(string, offset, symbol))


@pytest.mark.parametrize("most", [4096, 3])
def test_repeats_equal_brute_force(docs, rows, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "STRINGS", most)
    columns = ("id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "spans")
    found = {r.id: r for r in suffix_dedup.remove_repeats(docs, width=60, columns=columns).collect()}
    want = brute.repeats_cut([(i, t) for i, t, _ in rows], 60)
    assert {i: (found[i].n_bytes, found[i].n_removed, found[i].n_spans, bytes(found[i].kept)) for i in want} == want
    assert sum(w[1] for w in want.values()) > 2000
    assert found[1].n_bytes == 0 and found[None].n_removed == 0
    assert all(r.kept_sha256 == hashlib.sha256(bytes(r.kept)).hexdigest() for r in found.values())


def test_different_texts_of_one_id_are_documents_of_their_own(spark):
    draw = random.Random(11)
    noise = lambda n: "".join(draw.choice("abcdefghij ") for _ in range(n))
    shared, other = noise(160), noise(150)
    rows = [(1, noise(50) + shared + other), (1, noise(70)), (2, noise(90) + shared), (3, shared + noise(30)), (3, other), (3, other)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = sorted((r.id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(frame).collect())
    assert found == sorted([(1, 360, 0), (1, 70, 0), (2, 250, 160), (3, 190, 160), (3, 150, 150), (3, 150, 150)])
    twin = [(5, shared + noise(40)), (5, noise(20) + shared)]
    found = suffix_dedup.remove_repeats(spark.createDataFrame(twin, "doc_id long, text string")).collect()
    assert sorted(r.n_removed for r in found) == [0, 160]


def test_repeats_inside_one_long_text(spark, empty, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 5000)
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    part = " ".join(word() for _ in range(400))
    rows = [(4, part + " ".join(word() for _ in range(3000)) + part[300:900]), (2, "z" * 700), (3, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(frame).collect()}
    assert found == brute.repeats_cut(rows, 100)
    assert suffix_dedup.remove_repeats(empty).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><article>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <article>no</article> -->
<div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>{body}
<section id="comments"><p>First!</p></section><aside>More</aside><form><p>Search</p></form><footer>&copy; end</footer></body></html>"""


def test_main_text(spark):
    article = "<article><header><h1>A &amp; B</h1></header><p><b>one\n two<br>three<p>fo<i>ur</i>&nbsp;&#233; &lt;x&gt;<ul><li>five</ul>" \
        "<nav>inner</nav><div class='share'>s</div></article>"
    other = "<div id=content><h1>Head</h1><p>Long text of the page, the longest of all.</p></div>"
    rows = [(i, f"https://a.example/{i}", PAGE.format(body=article), 0, "t") for i in range(4)]
    rows += [(10 + i, f"https://b.example/{i}", PAGE.format(body=other), 0, "t") for i in range(3)]
    rows += [(20, None, None, 0, "t"), (21, "no host", "", 0, "t"), (22, "https://c.example", "just <b>text", 0, "t")]
    rows += [(23, "https://a.example/p", "<p>broken <article", 0, "t"), (0, *rows[0][1:]), (None, "https://a.example/n", rows[0][2], 0, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int, text string").repartition(3)
    found = html_extract.main_text(pages)
    by_id = {r.page_id: r.text for r in found.collect()}
    want = "A & B\none two three\nfour é <x>\nfive"
    assert all(by_id[i] == want for i in (0, 1, 2, 3, None))
    assert all(by_id[10 + i] == "Head\nLong text of the page, the longest of all." for i in range(3))
    assert by_id[20] == by_id[21] == "" and by_id[22] == "just text" and found.count() == len(rows)
    assert html_extract.main_text(pages.where("false")).count() == 0
    classes = html_extract.equivalence_classes(pages.where("page_id < 4"))
    outer = classes.where("outer").collect()
    assert any(r.main for r in outer) and len({(r.vector, r.support) for r in outer}) == 1


def test_text_of_the_template_is_deducted(spark):
    inside = "<main><div class=byline>Posted by the desk</div><p>Own text {i}, {i}.</p><p>Shared by few</p><div>Thanks for reading</div></main>"
    plain = "<div class=top>Welcome to the site</div><div class=body><p>Own words {i}.<p>More of page {i}.</div><div class=end>All rights</div>"
    late = "<div class=end>All rights</div><div class=top>Welcome to the site</div><div class=body><p>Own words 99.</div>"
    rows = [(i, f"https://a.example/{i}", inside.format(i=i) if i < 12 else inside.format(i=i).replace("Shared by few", "x")) for i in range(30)]
    rows += [(100 + i, f"https://b.example/{i}", f"<html><body>{plain.format(i=i)}</body></html>") for i in range(30)]
    rows += [(200, "https://b.example/404", "<html><body><p>Gone</body></html>"), (201, "https://b.example/x", f"<html><body>{late}</body></html>")]
    rows += [(300 + i, f"https://b.example/blank{i}", [None, "", " \n"][i % 3]) for i in range(20)]
    rows += [(400 + i, f"https://c.example/{i}", f"<p>{t}") for i, t in enumerate(["Same", "Same"])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = {r.page_id: r.text for r in html_extract.main_text(pages).collect()}
    assert all(found[i] == f"Own text {i}, {i}.\n" + ("Shared by few" if i < 12 else "x") for i in range(30))
    assert all(found[100 + i] == f"Own words {i}.\nMore of page {i}." for i in range(30))
    assert found[200] == "Gone" and "Own words 99." in found[201]
    assert all(found[300 + i] == "" for i in range(20)) and found[400] == found[401] == "Same"
    classes = html_extract.equivalence_classes(pages).where("text is not null").collect()
    assert len(classes) == 4 and all(r.size > 1 for r in classes)


def test_what_articles_share_stays(spark):
    dish = "<article><h1>Dish {i}</h1><h2>Ingredients</h2><p>Salt {i} times</p><h2>Method</h2><p>Stir {i} times</p></article>"
    grid = "<main><table><tr><th>Size</th><th>Unit</th></tr><tr><td>{i} of 9</td><td>metres</td></tr></table></main>"
    rows = [(i, f"https://a.example/{i}", f"<body><div>Kitchen</div>{dish.format(i=i)}<div>The end</div></body>") for i in range(4)]
    rows += [(10 + i, f"https://b.example/{i}", f"<body>{grid.format(i=i)}</body>") for i in range(4)]
    rows += [(20 + i, f"https://c.example/{i}", f"<body><div id=top>Site</div><div id=text><h2>Notes</h2><p>{i} words</p></div></body>") for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = {r.page_id: r.text for r in html_extract.main_text(pages).collect()}
    for i in range(4):
        assert found[i] == f"Dish {i}\nIngredients\nSalt {i} times\nMethod\nStir {i} times"
        assert found[10 + i] == f"Size\nUnit\n{i} of 9\nmetres"
        assert found[20 + i].endswith(f"Notes\n{i} words")


def test_an_article_in_two_elements_is_whole(spark):
    body = "<div class=head>The site</div><div id=content><div class=lead><p>{a}</div><div class=story><p>{b}</div></div>"
    rows = [(i, f"https://a.example/{i}", body.format(a=f"{i} lead" * 4, b=f"{i} tale" * 6)) for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html_extract.main_text(pages).collect()}
    assert all(found[i] == f"{i} lead" * 4 + "\n" + f"{i} tale" * 6 for i in range(6))
    (host,) = html_extract.templates(html_extract.equivalence_classes(pages)).collect()
    assert host.top == "/div.content" and len(host.fixed) == 1


@pytest.mark.parametrize("page, text", [
    ("<body class='no-sidebar'><p>Kept</p></body>", "Kept"),
    ("<body class='sidebar'><div class='main-nav'>Go</div><p>Kept words</p></body>", "Kept words"),
    ("<article class='post comments-open'><p>Kept</p></article>", "Kept"),
    ("<main id=comments><p>Kept</p></main>", "Kept"),
    ("<div class='widget-area content'><p>Kept</p></div>", "Kept"),
    ("<div id='search-page'><div class='alert-free'>Kept</div></div>", "Kept"),
    ("<div class='right-sidebar'><article>Kept</article><p>Not it, but long</p></div>", "Kept"),
    ("<div class='share'><p>Nearly all of the text.</p></div><p>Bit</p>", "Nearly all of the text.\nBit"),
    ("<p>Text</p><div id=comments>Far more than the text by its readers</div><div class='ad ad-300x250'>Buy</div>", "Text"),
    ("<p>Text of it</p><div class='cookie-notice box'>We use</div><div id='site-footer'>End</div><ul class=nav2>Go</ul>", "Text of it"),
    ("<p>So <math><mi>x</mi><mo>=</mo><msup><mn>2</mn></msup></math> holds</p>", "So x=2 holds"),
])
def test_names_hide_no_article(page, text):
    assert html_extract.article(page, None) == text


def test_given_pages_hold_their_article(spark):
    for r in queries.op10_html_extraction(spark, SF).collect():
        assert r.text and r.n_chars == len(r.text)


def test_toxicity_chain(spark, docs, empty):
    docs_ = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = queries.category_labels(spark, "/root/testdata/sf0.1")
    known = labels.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(4)) > 0)
    model = toxicity.train(docs_, known, list(queries.CATEGORIES), max_rows=2500)
    held = toxicity.score(docs_, model).join(labels.join(known, "doc_id", "left_anti"), F.col("id") == F.col("doc_id"))
    said = F.col("p_toxic") >= model.cuts[1]
    n, hit, wrong = held.agg(F.sum("toxic"), F.sum((said & (F.col("toxic") == 1)).cast("int")), F.sum((said & (F.col("toxic") == 0)).cast("int"))).first()
    # some of these labels are wrong on purpose
    assert hit / n > 0.85 and wrong <= 15
    assert len(model.models[1][0]) == len(model.hashes) + 1
    scores = toxicity.score(docs, model)
    assert scores.count() == docs.count() and toxicity.score(empty, model).count() == 0
    left = toxicity.reject(docs, model, "toxic")
    assert left.columns == docs.columns and left.where("doc_id = 1").count() == 1
    none = toxicity.train(docs_, labels.where("false"), ["toxic"])
    assert toxicity.reject(docs, none, "toxic").count() == docs.count()


def test_chain_uses_earlier_categories_out_of_fold():
    draw = np.random.default_rng(0)
    x = draw.integers(0, 2, (600, 5)).astype(np.float32)
    first = ((x[:, 0] + x[:, 1]) == 2).astype(float)
    models, cuts = toxicity.fit_chain(x, np.stack([first, first], 1), np.arange(600) % 5, 1e-3)
    assert models[1][0][-1] > 1 and all(0 < c < 1 for c in cuts)
    flat = toxicity.fit_chain(x, np.zeros((600, 1)), np.arange(600) % 5, 1e-3)[0]
    assert toxicity.probability(x, flat[0]).max() < 0.01


def test_rows_without_an_id_stay_out_of_the_window_and_repeated_ids_do_not_follow_the_order(spark):
    import corpus_pipeline

    rows = [(1, "one two three"), (1, "four five six"), (None, "same text"), (None, "same text"), (2, "seven")]
    kept = []
    for given in (rows, rows[::-1]):
        frame = spark.createDataFrame(given, "doc_id long, text string").coalesce(1)
        left = corpus_pipeline.keep_one_of_each_group(spark, frame, SF)
        assert "Union" in left._jdf.queryExecution().optimizedPlan().toString()
        kept.append(sorted((str(r.doc_id), r.text) for r in left.collect()))
    assert kept[0] == kept[1] and [i for i, _ in kept[0]] == ["1", "2", "None", "None"]


def test_pipeline_stages_keep_columns_whose_names_they_use_inside(spark):
    import corpus_pipeline

    rows = [(1, "a line of some six words", None, 7, 5), (2, "a line of some six words\nmore", 3, 7, 6), (None, None, 1, 7, 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, lines_removed int, nth int")
    left = corpus_pipeline.drop_repeated_lines(spark, frame, SF)
    assert left.columns == frame.columns
    got = {r.doc_id: tuple(r)[1:] for r in left.collect()}
    assert got == {1: rows[0][1:], 2: ("more", 4, 7, 6), None: rows[2][1:]}
    left = corpus_pipeline.keep_one_of_each_group(spark, frame, SF)
    assert left.columns == frame.columns and sorted(r.nth for r in left.collect()) == [5, 6, 7]
    empty = frame.where("false")
    assert corpus_pipeline.drop_repeated_lines(spark, empty, SF).count() == 0


def test_pipeline_rewrites_a_text_once(spark):
    import corpus_pipeline

    frame = spark.createDataFrame([(1, "a line\na line", 13), (2, "a line", 6)], "doc_id long, text string, n_chars long")
    left = corpus_pipeline.drop_repeated_lines(spark, frame, SF)
    assert left._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert [tuple(r) for r in left.collect()] == [(1, "a line", 6)]


def test_pipeline_equals_its_stages_by_brute_force(spark):
    import sentencepiece

    import corpus_pipeline

    docs = queries.table(spark, SF, "documents")
    plain = lambda frame: [(r.doc_id, r.text) for r in frame.collect()]
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before, kept = plain(kept), shared.stored(stage(spark, kept, SF))
        if name == "toxicity":
            toxic = {r.doc_id for r in queries.table(spark, SF, "labels").where("toxic = 1").collect()}
            clean = {r.doc_id for r in queries.table(spark, SF, "labels").where("toxic = 0").collect()}
            left = {r.doc_id for r in kept.collect()}
            # some of these labels are wrong on purpose
            assert len(left & toxic) <= 0.15 * len(toxic) and len(clean - left) <= 0.03 * len(clean)
        elif name == "line_dedup":
            want = {i: t for i, t in brute.lines_kept(before).items() if t.strip() or not dict(before)[i].strip()}
            assert dict(plain(kept)) == want
        elif name == "ngram_jaccard_join":
            want = {i for i, (_, c) in brute.classes(before, 5, 80, 100).items() if i == c}
            assert {i for i, _ in plain(kept)} == want
        elif name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in queries.table(spark, SF, "benchmark").collect()]
            assert {i for i, _ in plain(kept)} == {i for i, w in brute.hits(before, items).items() if not w[1]}
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
            assert {r.doc_id: r.ids for r in kept.collect()} == {i: library.encode(t, add_eos=True) for i, t in before}
        if name != "sentencepiece":
            assert kept.columns == docs.columns


def test_small_batches_are_for_the_jobs_inside(spark):
    def batch_bytes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    rows = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("x"), 1000).alias("text"))
    sizes = lambda: [r.n for r in rows.mapInArrow(batch_bytes, "n long").collect()]
    with shared.small_batches(spark, 100_000):
        assert len(sizes()) > 10 and max(sizes()) < 200_000
        with shared.small_batches(spark, 1 << 20):
            assert spark.conf.get(name).rstrip("b") == "100000"
    assert spark.conf.get(name) == before and len(sizes()) == 1
