import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from coterie.functions.columns import dense_index, number_or_null
from coterie.functions.tables import to_long
from coterie.operators import consensus, ids, labels, qc, validate
from coterie.plans import jobs
from coterie.plans.jobs import Dataset, load_datasets, run_multi, write_results
from coterie.sources import catalog, mappings, matrix, series

import helpers as h


def write_matrix(path, sep="\t", comments=False, n=12, junk=None, zipped=False):
    lines = ["! about this file", "!more"] if comments else []
    lines.append(sep.join(["ID", "s1", "s2"] + (["note"] if junk else [])))
    for i in range(n):
        lines.append(sep.join([f"g{i % 11}", str(i), "NA" if i == 0 else str(i * 2.5)] + ([junk] if junk else [])))
    text = "\n".join(lines) + "\n"
    if zipped:
        path.write_bytes(gzip.compress(text.encode()))
    else:
        path.write_text(text)
    return str(path)


@pytest.mark.parametrize("sep,comments,zipped", [("\t", False, False), (",", True, False), ("\t", True, True)])
def test_read_matrix_layouts(spark, tmp_path, sep, comments, zipped):
    path = write_matrix(tmp_path / ("m.txt.gz" if zipped else "m.txt"), sep, comments, junk="text", zipped=zipped)
    cells = {(r.sample_id, r.gene): r.value for r in matrix.read_matrix(spark, path).collect()}
    assert set(s for s, _ in cells) == {"s1", "s2"}  # the text column is dropped
    assert cells["s1", "g0"] == 5.5  # rows 0 and 11 share an ID
    assert cells["s2", "g0"] == 27.5  # of which one is missing
    assert cells["s1", "g3"] == 3.0


def test_read_matrix_rejects_small_and_textual_files(spark, tmp_path):
    small = write_matrix(tmp_path / "small.txt", n=10)
    assert matrix.read_matrix(spark, small) is None
    text = tmp_path / "text.txt"
    text.write_text("a\tb\n" + "x\ty\n" * 20)
    assert matrix.read_matrix(spark, str(text)) is None
    good = write_matrix(tmp_path / "good.txt", n=20)
    assert matrix.first_acceptable(spark, [small, str(text), good]).select("gene").distinct().count() == 11
    with pytest.raises(ValueError, match="no parseable"):
        matrix.first_acceptable(spark, [small])


def test_numbers_in_text(spark):
    texts = ["1.5", " 2 ", "NaN", "x", "", "1d", "3f", "1e3", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(number_or_null(F.col("t"))).collect()] == [
        1.5, 2.0, None, None, None, None, None, 1000.0, None]


def test_detect_columns_takes_the_first_table_with_values(spark):
    empty = spark.createDataFrame([], "ID_REF string, VALUE string")
    texts = spark.createDataFrame([("a", "x")], "ID_REF string, note string")
    mixed = spark.createDataFrame([("a", "1", "n/a"), ("b", "2", "3")], "name string, other string, VALUE string")
    assert series.detect_columns([empty, texts]) is None
    # VALUE is not wholly numeric, so the mostly numeric column is taken.
    assert series.detect_columns([empty, texts, mixed]) == ("name", "other")


def test_links_drop_redirects(spark):
    html = ('<a href="https://www.hhs.gov/policy/index.html">x</a><a href="?C=N">s</a><a href="/geo/">up</a>'
            '<a href="GSE1_counts.txt.gz">f</a>')
    df = spark.createDataFrame([(html,)], "html string")
    assert [r.url for r in catalog.extract_file_links(df, "b/").collect()] == ["b/GSE1_counts.txt.gz"]


def test_ranking_prefers_matrices_and_skips_junctions(spark):
    urls = ["https://h/x_JC.raw.A3SS_ID.txt", "https://h/plain.txt", "https://h/a_rawCount.txt.gz", "none", "rel.txt"]
    df = spark.createDataFrame([(u, "metadata", i) for i, u in enumerate(urls)] + [("https://h/plain.txt", "listing", 0)],
                               "url string, source string, ord int")
    assert [r.url for r in catalog.rank_candidate_files(df).collect()] == ["https://h/a_rawCount.txt.gz", "https://h/plain.txt"]


def test_gene_info_later_lines_overwrite(spark, tmp_path):
    p = tmp_path / "info"
    p.write_text("#tax\tid\n9606\t1\tOLD\t-\t-\tMIM:1|Ensembl:ENSG1\n9606\t2\tshort\n9606\t3\tNEW\t-\t-\tEnsembl:ENSG1|Ensembl:ENSG2\n")
    assert {r.id: r.symbol for r in mappings.read_gene_info(spark, str(p)).collect()} == {"ENSG1": "NEW", "ENSG2": "NEW"}


def test_probe_map_without_symbols(spark):
    df = spark.createDataFrame([("p", "x", 0)], "ID string, title string, ord int")
    assert mappings.read_probe_map(df) is None


def test_dense_index_over_many_buckets(spark):
    df = spark.createDataFrame([(g, o) for g in "ab" for o in (3, 900, 17, 400, 2**33)], "g string, ord long")
    t = dense_index(df, "ord", ["g"], bucket_rows=100).toPandas().sort_values(["g", "ord"])
    assert t["idx"].tolist() == [0, 1, 2, 3, 4] * 2


def test_empty_mappings(spark):
    expr = spark.createDataFrame([("d", 1, "ENSG1", 2.0)], "dataset string, sample_id int, gene string, value double")
    none = spark.createDataFrame([], "id string, symbol string")
    assert ids.convert_ids(expr, none).isEmpty()
    assert ids.map_probes(expr, none).first().gene == "ENSG1"


def test_dedup_is_idempotent_and_skips_missing(spark):
    rows = [("d", 1, "g", 1.0), ("d", 1, "g", None), ("d", 1, "g", 3.0), ("d", 2, "g", None)]
    expr = spark.createDataFrame(rows, "dataset string, sample_id int, gene string, value double")
    once = ids.dedup_mean(expr)
    assert sorted(once.collect(), key=str) == sorted(ids.dedup_mean(once).collect(), key=str)
    assert {r.sample_id: r.value for r in once.collect()} == {1: 2.0, 2: None}
    with pytest.raises(ValueError, match="duplicate"):
        ids.assert_unique(expr)


def test_offsets_do_not_overlap(spark):
    df = spark.createDataFrame([("b", 1, 0), ("b", 2, 2), ("a", 1, 0), ("a", 2, 1)], "dataset string, sample_id int, y int")
    got = {(r.dataset, r.sample_id): r.y for r in labels.offset_labels(df).collect()}
    assert got == {("a", 1): 0, ("a", 2): 1, ("b", 1): 2, ("b", 2): 4}


def test_label_text_of_unknown_samples(spark):
    samples = spark.createDataFrame([("a",), ("zz",)], "sample_id string")
    meta = spark.createDataFrame([("a", [], ["Blood"], ["T"])],
                                 "sample_id string, characteristics array<string>, source_name array<string>, title array<string>")
    assert {r.sample_id: r.label for r in labels.label_text_for(samples, meta).collect()} == {"a": "blood", "zz": "unknown"}


def test_no_common_genes_is_an_error_with_a_diagnosis(spark):
    expr = spark.createDataFrame([("a", 1, "x", 1.0), ("b", 1, "y", 1.0)], "dataset string, sample_id int, gene string, value double")
    y = spark.createDataFrame([("a", 1, 0), ("b", 1, 0)], "dataset string, sample_id int, y int")
    with pytest.raises(ValueError, match="no genes in common.*a: 1 genes, first x"):
        qc.merge_datasets(expr, y)


def specs(spark, n=40):
    x, truth = h.blobs(n, 2, 15, spread=1.0)

    def cells(scale):
        rows = [(f"s{i}", f"g{g}", float(v) * scale) for i, r in enumerate(x) for g, v in enumerate(r)]
        return lambda s: s.createDataFrame(rows, "sample_id string, gene string, value double")

    def codes(s):
        return s.createDataFrame([(f"s{i}", int(c), i) for i, c in enumerate(truth)], "sample_id string, y int, ord int")

    def broken(_):
        raise OSError("no file")

    return [Dataset("one", cells(1.0), codes), Dataset("broken", broken, codes), Dataset("two", cells(7.0), codes)]


def test_a_failing_data_set_is_skipped_and_reported(spark):
    expr, y, report = load_datasets(spark, specs(spark))
    assert {r.dataset: r.loaded for r in report.collect()} == {"one": True, "broken": False, "two": True}
    assert "no file" in report.filter("NOT loaded").first().error
    assert y.groupBy("dataset").agg(F.min("y"), F.max("y")).orderBy("dataset").collect() == [("one", 0, 1), ("two", 2, 3)]
    z = expr.groupBy("dataset", "gene").agg(F.avg("value").alias("m"), F.stddev("value").alias("s")).toPandas()
    assert np.allclose(z["m"], 0) and np.allclose(z["s"], 1)
    with pytest.raises(ValueError, match="no data set"):
        load_datasets(spark, [specs(spark)[1]])


def test_labels_by_position_when_no_id_matches(spark):
    one, _, two = specs(spark)
    codes = two.labels
    two.labels = lambda s: codes(s).withColumn("sample_id", F.concat(F.lit("other-"), "sample_id"))
    two.sample_order = codes(spark).select("sample_id", "ord")
    _, y, _ = load_datasets(spark, [one, two])
    got = {r.sample_id: r.y for r in y.filter("dataset = 'two'").collect()}
    assert got == {f"two/s{i}": i % 2 + 2 for i in range(40)}


def test_whole_job_on_two_data_sets(spark, tmp_path):
    out = run_multi(spark, specs(spark), n_init=2, n_trees=5, k_range=(2, 3))
    row = out["metrics"].first()
    assert row.silhouette > 0.5 and row.ari > 0.3  # the data sets differ in label only
    assert out["ablation"].count() == 4
    write_results({k: out[k] for k in ("labels", "metrics", "heatmap", "silhouette_histogram", "plane")}, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r" / "labels")).count() == 80


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1


def test_missing_values_do_not_hide_the_value_column(spark):
    df = spark.createDataFrame([("a", 0.1, 1.0), ("b", 0.2, None)], "ID_REF string, DETECTION_P double, VALUE double")
    assert series.detect_columns(df) == ("ID_REF", "VALUE")
    text = spark.createDataFrame([("a", "0.1", "1"), ("b", "0.2", " ")], "ID_REF string, DETECTION_P string, VALUE string")
    assert series.detect_columns(text) == ("ID_REF", "VALUE")


def test_an_error_in_a_late_row_stays_in_its_data_set(spark):
    one, _, two = specs(spark)
    cells = two.load

    def late(s):
        bad = F.when((F.col("sample_id") == "s39"), F.raise_error(F.lit("bad row"))).otherwise(F.col("value"))
        return cells(s).withColumn("value", bad.cast("double"))

    two.load = late
    expr, _, report = load_datasets(spark, [one, two])
    assert {r.dataset: r.loaded for r in report.collect()} == {"one": True, "two": False}
    assert "bad row" in report.filter("NOT loaded").first().error
    assert {r.dataset for r in expr.select("dataset").distinct().collect()} == {"one"}
    with pytest.raises(ValueError, match="one name"):
        load_datasets(spark, [one, one])


def test_ids_are_judged_by_the_first_row_of_the_file(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("ID\ts1\ts2\n" + "".join(f"{g}\t{i}\t{i}\n" for i, g in enumerate(
        ["ENSG1", "AFFX-1", "AFFX-1"] + [f"ENSG{k}" for k in range(2, 14)])))
    cells = matrix.read_matrix(spark, str(tmp_path / "m.tsv"), with_order=True).withColumn("dataset", F.lit("d"))
    info = spark.createDataFrame([("ENSG1", "ONE"), ("ENSG2", ""), ("ENSG3", "THREE")], "id string, symbol string")
    assert {r.gene for r in ids.convert_prefixed_ids(cells, info, "ord").collect()} == {"ONE", "THREE"}
    assert {r.gene for r in ids.convert_prefixed_ids(cells, info, "gene").collect()} > {"AFFX-1", "ENSG1", "ENSG2"}


def test_many_cells_are_dealt_over_more_tasks(spark, monkeypatch):
    from coterie import session
    from coterie.operators import ids

    cells = [(d, s, g, float(s + g)) for d in "ab" for s in range(20) for g in range(5)] + [("a", 1, 9, 1.0), ("a", 0, 0, 4.0)]
    expr = spark.createDataFrame(cells, "dataset string, sample_id int, gene int, value double")
    monkeypatch.setattr(session, "ROWS_PER_TASK", 4)
    kept = ids.intersect_genes(expr)
    assert kept.rdd.getNumPartitions() == 51 > session.shuffle_width(spark)  # 201 cells, 4 to a task
    got = {(r.dataset, r.sample_id, r.gene): r.value for r in ids.dedup_mean(kept).collect()}
    assert got == {c[:3]: c[3] for c in cells[:-2]} | {("a", 0, 0): 2.0}


def test_an_analysis_computes_each_base_clustering_once(spark, monkeypatch):
    """The ensemble and the ablation share them."""
    seen = []

    def counted(name):
        def run(samples, k, *_, **__):
            seen.append(name)
            return samples.select("sample_id", (F.col("features")[0] > 0).cast("int").alias("cluster"))

        return run

    for module in (consensus, validate):
        for name in ("kmeans", "ward", "spectral"):
            if module is validate or name != "kmeans":  # the hard consensus is a k-means of its own
                monkeypatch.setattr(module, name, counted(name))
    monkeypatch.setattr(jobs, "classifier_test", lambda samples, *_: samples)
    x, truth = h.blobs(60, 2, 4)
    cells = to_long(h.to_samples(spark, x))
    out = jobs.run_single(cells, h.to_samples(spark, x[:, :1], y=truth).select("sample_id", "y"), n_init=2, k_range=(2, 2), figures=False)
    assert out["ablation"].count() == 4
    assert sorted(seen) == ["kmeans", "spectral", "ward"]
