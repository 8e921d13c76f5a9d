import random

import pytest
from pyspark.sql import functions as F

from embgauge.sources import datasets, embeddings, results
from embgauge.sources.catalogue import Catalogue, Entry
from embgauge.sources.tsv import ends_inside, read_records


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_catalogue_families_and_unknown_name():
    catalogue = Catalogue.standard("/data")
    assert catalogue["mr"].files == {"all": "/data/tcls_datasets/mr.csv"}
    assert catalogue["trec"].files["test"].endswith("trec_test.csv")
    assert (catalogue["sts121"].base_name, catalogue["sts121"].side) == ("sts12", 1)
    assert (catalogue["mrpc2"].base_name, catalogue["mrpc2"].side) == ("mrpc", 2)
    assert catalogue["sstf"].side is None and catalogue["sstf"].base_name == "sstf"
    assert catalogue["stsb1"].files.keys() == {"test"}
    with pytest.raises(KeyError, match="unknown dataset"):
        catalogue["nope"]


def test_tsv_dataset_is_numbered_over_splits(spark, tmp_path):
    train = write(tmp_path / "a.csv", "text\tlabel", "one\t0", '"two\nlines"\t1', '"tab\there"\t1')
    test = write(tmp_path / "b.csv", "text\tlabel", "\t0", "five\t1")
    catalogue = Catalogue([Entry("x", "split", {"train": train, "test": test})])
    rows = datasets.read_dataset(spark, "x", catalogue).orderBy("row_id").collect()
    assert [(r.row_id, r.split, r.text, r.label) for r in rows] == [
        (0, "train", "one", 0), (1, "train", "two\nlines", 1), (2, "train", "tab\there", 1),
        (3, "test", None, 0), (4, "test", "five", 1),
    ]


def test_scores_and_pair_labels(spark, tmp_path):
    scores = write(tmp_path / "s.csv", "score", "2.500", "0", "5.0")
    assert [tuple(r) for r in datasets.read_scores(spark, scores).orderBy("pair_id").collect()] == [
        (0, 2.5), (1, 0.0), (2, 5.0),
    ]
    train, test = write(tmp_path / "l.csv", "score", "1", "0"), write(tmp_path / "m.csv", "score", "1")
    labels = datasets.read_pair_labels(spark, train, test).orderBy("pair_id").collect()
    assert [tuple(r) for r in labels] == [(0, "train", 1), (1, "train", 0), (2, "test", 1)]


def test_contract(spark):
    good = spark.createDataFrame([(1.5, "3", "a")], "f0 double, label string, SMILES string")
    out = datasets.apply_contract(good)
    assert out.columns == ["text", "label", "f0"] and out.first().label == 3
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        datasets.apply_contract(spark.createDataFrame([("a", "x")], "text string, label string")).collect()
    with pytest.raises(ValueError, match="floating"):
        datasets.apply_contract(spark.createDataFrame([("a", 1, 2)], "text string, label int, f0 int"))
    with pytest.raises(ValueError, match="string"):
        datasets.apply_contract(spark.createDataFrame([(1, 1)], "text int, label int"))
    with pytest.raises(ValueError, match="missing"):
        datasets.apply_contract(spark.createDataFrame([("a",)], "text string"))


def test_embedding_store_round_trip_and_pruning(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = spark.createDataFrame(
        [("d1", "e1", "train", None, 0, "a", 1, [1.0, 2.0]), ("d1", "e1", "test", None, 1, "b", 0, [3.0, 4.0]),
         ("d2", "e1", "train", None, 0, "c", 1, [5.0, 6.0])],
        "dataset string, encoder string, split string, side int, row_id long, text string, label int, embedding array<double>",
    )
    embeddings.write_embeddings(rows, root)
    back = embeddings.read_embeddings(spark, root, "d1", "e1")
    assert [r.embedding for r in back.orderBy("row_id").collect()] == [[1.0, 2.0], [3.0, 4.0]]
    assert embeddings.read_embeddings(spark, root, "d1", "e1", "test").count() == 1
    assert len(back.inputFiles()) == 3 or back.rdd.getNumPartitions() <= 2
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset" in plan
    with pytest.raises(ValueError, match="lack"):
        embeddings.write_embeddings(rows.drop("row_id"), root)


def test_wide_layout_round_trip(spark):
    rows = spark.createDataFrame([("a", 1, [0.5, 1.5, 2.5])], "text string, label int, embedding array<double>")
    wide = embeddings.to_wide(rows, 3)
    assert wide.columns == ["text", "label", "0", "1", "2"]
    assert embeddings.from_wide(wide).first().embedding == [0.5, 1.5, 2.5]


def test_wide_tsv_round_trip(spark, tmp_path):
    path = str(tmp_path / "wide")
    texts = ["plain", "tab\tand\nline", 'a "quoted" word', "x" * 5000]
    rows = spark.createDataFrame(
        [(i, t, i % 2, [i + 0.25, -1.5e-7 * i]) for i, t in enumerate(texts)],
        "row_id long, text string, label int, embedding array<double>",
    )
    embeddings.write_wide(rows.repartition(3), 2, path)
    back = datasets.apply_contract(embeddings.read_wide(spark, path))
    found = {r.text: (r.label, r.embedding) for r in back.collect()}
    assert found == {r.text: (r.label, r.embedding) for r in rows.collect()}
    assert [r.text for r in back.orderBy("row_id").collect()] == texts
    assert [r.row_id for r in back.orderBy("row_id").collect()] == [0, 1, 2, 3]


def test_row_ids_follow_file_names_whatever_their_size(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    expected = []
    for name, count in (("a", 3), ("b", 400), ("c", 20), ("d", 1)):
        lines = [f"{name}{i}" for i in range(count)]
        write(folder / f"{name}.csv", "text", *lines)
        expected += lines
    rows = datasets.with_row_ids(datasets.read_tsv(spark, str(folder), "text string")).orderBy("row_id").collect()
    assert [r.text for r in rows] == expected and [r.row_id for r in rows] == list(range(424))


@pytest.fixture
def small_blocks(spark):
    """Files are read in blocks of some hundred bytes."""
    names = {"maxPartitionBytes": 700, "openCostInBytes": 100, "minPartitionNum": 1}
    for name, value in names.items():
        spark.conf.set(f"spark.sql.files.{name}", value)
    yield
    for name in names:
        spark.conf.unset(f"spark.sql.files.{name}")


@pytest.mark.parametrize("line, inside, after", [
    ("a\tb", False, False), ("a\tb", True, True), ('a\t"b', False, True), ('b"\t1', True, False), ('"a ""b""', False, True),
    ('""\t""', False, False), ('5" pipe', False, False), ('b"\t"c', True, True), ('"a"b\t"c', False, True), ('"a""', False, True),
])
def test_state_at_line_ends(line, inside, after):
    assert ends_inside(line, inside) is after


@pytest.mark.parametrize("letters, longest, end", [
    ('ab "\t\n', 20, "\n"), ('ab "\t\n\r', 300, "\n"), ("ab é\n", 3000, "\n"), ("ab c", 40, "\r\n"), ('a"\n', 60, "\r\n"),
])
def test_blocks_of_a_quoted_tsv_equal_the_whole_file(spark, tmp_path, small_blocks, letters, longest, end):
    draw = random.Random(longest)
    quoted = lambda s: '"' + s.replace('"', '""') + '"' if any(c in s for c in '"\t\n\r') else s
    text = lambda: "".join(draw.choice(letters) for _ in range(draw.choice([0, 1, 3, 20, longest])))
    for name, count in (("a", 150), ("b", 0), ("c", 1), ("d", 90)):
        lines = "".join(f"{quoted(text())}\t{draw.randrange(5)}{end}" for _ in range(count))
        (tmp_path / f"{name}.csv").write_bytes(f"text\tlabel{end}{lines}".encode())
    (tmp_path / "e.csv").write_bytes(b"")
    schema = "text string, label int"
    plain = datasets.with_row_ids(datasets.read_tsv(spark, str(tmp_path), schema), first=[])
    found, count = read_records(spark, str(tmp_path), schema, "row_id", 7)
    assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 3
    rows = [(r.row_id - 7, r.text, r.label) for r in found.orderBy("row_id").collect()]
    assert rows == [(r.row_id, r.text, r.label) for r in plain.orderBy("row_id").collect()]
    assert count == len(rows) == 241


def test_blocks_joined_without_a_broadcast(spark, tmp_path, small_blocks, monkeypatch):
    lines = [f'"{"x" * (i % 50)}\n""{i}"""\t{i}' for i in range(200)]
    path = write(tmp_path / "a.csv", "text\tlabel", *lines)
    monkeypatch.setattr("embgauge.functions.kernels.MAX_BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found, _ = read_records(spark, path, "text string, label int", "row_id")
        rows = [(r.row_id, r.text, r.label) for r in found.orderBy("row_id").collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows == [(i, f'{"x" * (i % 50)}\n"{i}"', i) for i in range(200)]


def test_an_open_quote_reaches_the_end_and_bad_records_fail(spark, tmp_path):
    path = write(tmp_path / "a.csv", "text\tlabel", "one\t1", '"two\t2', "three\t3")
    found, count = read_records(spark, path, "text string, label string", "row_id")
    with pytest.raises(Exception, match="MALFORMED_RECORD|Malformed"):
        found.collect()
    assert count == 2
    path = write(tmp_path / "b.csv", "text", "one", '"two', "three")
    found, _ = read_records(spark, path, "text string", "row_id")
    assert [r.row_id for r in found.orderBy("row_id").collect()] == [0, 1]


def test_results_resume(spark, tmp_path):
    root = str(tmp_path / "results")
    assert results.read_results(spark, root).count() == 0
    one = [("sts", "d", "e", "none", "cosine", "pearson", None, 1.0, "r1")]
    results.append_results(results.results_frame(spark, one), root)
    wanted = spark.createDataFrame(
        [("sts", "d", "e", "none", "cosine"), ("sts", "d", "e", "zca", "cosine")],
        "task string, dataset string, encoder string, whitening string, model string",
    )
    assert [r.whitening for r in results.pending(spark, wanted, root).collect()] == ["zca"]
    results.append_results(results.results_frame(spark, [one[0][:7] + (2.0, "r2")]), root)
    latest = results.latest(results.read_results(spark, root)).collect()
    assert [(r.value, r.run_id) for r in latest] == [(2.0, "r2")]
    results.export_json(results.read_results(spark, root), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).where(F.col("metric") == "pearson").count() == 2
