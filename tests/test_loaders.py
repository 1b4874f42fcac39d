import pytest
from pyspark.sql import functions as F

from coterie.plans.loaders import Series, load_labelled, load_series

META = "sample_id string, characteristics array<string>, source_name array<string>, title array<string>"
CATALOG = "url string, source string, ord int"


def write(path, rows):
    path.write_text("\n".join("\t".join(r) for r in rows) + "\n")
    return str(path)


def meta_of(spark):
    return spark.createDataFrame([("s1", ["Tumor", "A"], ["x"], ["t"]), ("s2", [], ["Normal"], ["t"]), ("s9", None, None, None)], META)


def cells_of(expr):
    return {(r.sample_id, r.gene): r.value for r in expr.collect()}


def test_sample_tables_come_first(spark, tmp_path):
    tables = spark.createDataFrame(
        [("s1", 0, "ENSG1", "1"), ("s1", 1, "ENSG2", "3"), ("s2", 0, "ENSG1", "5"), ("s2", 1, "p", "7"), ("s3", 0, "ENSG2", "x")],
        "sample_id string, ord int, ID_REF string, VALUE string").where("sample_id <> 's3'")
    empty = spark.createDataFrame([], "sample_id string, ID_REF string, VALUE string")
    info = spark.createDataFrame([("ENSG1", "A"), ("ENSG2", "A")], "id string, symbol string")
    files = spark.createDataFrame([("https://h/a.txt", "metadata", 0)], CATALOG)
    expr, labels, trace = load_series(spark, Series("S", [empty, tables], files, meta_of(spark)), info)
    assert cells_of(expr) == {("s1", "A"): 2.0, ("s2", "A"): 5.0}  # "p" has no symbol
    assert [(r.source, r.used, r.outcome) for r in trace.collect()] == [("tables", True, "matrix")]
    assert sorted((r.sample_id, r.label, r.y) for r in labels.collect()) == [("s1", "tumor|a", 0), ("s2", "normal", 1)]


def test_files_are_tried_in_order_until_one_fits(spark, tmp_path):
    good = write(tmp_path / "good.txt", [["ID", "s2", "s1"], *([f"p{i % 12}", str(i), "NA" if i == 3 else "1"] for i in range(13))])
    late = write(tmp_path / "late.txt", [["ID", "s2", "s1"], *([f"q{i}", "1", "1"] for i in range(20))])
    narrow = write(tmp_path / "narrow_matrix.txt", [["ID", "s1"], *([f"q{i}", "1"] for i in range(20))])
    landed = {"https://h/good.txt": good, "https://h/late.txt": late, "https://h/narrow_matrix.txt": narrow,
              "https://h/lost_counts.txt": str(tmp_path / "lost")}
    urls = ["https://h/good.txt", "https://h/late.txt", "https://h/narrow_matrix.txt", "https://h/lost_counts.txt",
            "https://h/absent_expr.txt", "https://h/readme.txt"]
    files = spark.createDataFrame([(u, "metadata", i) for i, u in enumerate(urls)], CATALOG)
    probes = spark.createDataFrame([("p0", "G /// H", 0), ("p1", "G", 1)], "ID string, `Gene Symbol` string, ord int")
    expr, labels, trace = load_series(spark, Series("S", [], files, meta_of(spark), probes, landed.get))
    tried = [(r.name.split("/")[-1], r.used, r.outcome) for r in trace.orderBy("ord").collect()]
    assert tried[0][0] == "S" and tried[1] == ("narrow_matrix.txt", False, "no usable matrix") and tried[3] == (
        "absent_expr.txt", False, "not there") and tried[4] == ("good.txt", True, "matrix") and len(tried) == 5
    assert tried[2][0] == "lost_counts.txt" and tried[2][2] == "AnalysisException"
    got = cells_of(expr)
    # Rows 0 and 12 share a probe; their mean and probe 1 share a symbol.
    assert got["s2", "G"] == ((0 + 12) / 2 + 1) / 2 and got["s1", "p3"] is None and ("s1", "q1") not in got
    assert sorted((r.sample_id, r.label, r.y) for r in labels.collect()) == [("s1", "tumor|a", 0), ("s2", "normal", 1)]


def test_a_series_without_any_source(spark):
    files = spark.createDataFrame([("https://h/a.txt", "metadata", 0)], CATALOG)
    texts = spark.createDataFrame([("s1", "g", "words")], "sample_id string, ID_REF string, note string")
    with pytest.raises(ValueError, match="a.txt.*not there"):
        load_series(spark, Series("S", [texts], files, meta_of(spark), landed=lambda url: None))
    with pytest.raises(ValueError, match="no source"):
        load_series(spark, Series("S", [], files.limit(0), meta_of(spark)))


@pytest.mark.parametrize("turned", [False, True])
def test_labelled_matrix_by_position(spark, turned):
    """Five genes and three samples, whichever are the rows; a column without values."""
    cells = [(f"g{i}", 10 - i, f"s{j}", j, float(10 * i + j)) for i in range(5) for j in range(3)]
    if turned:
        cells = [(c, co, r, ro, v) for r, ro, c, co, v in cells]
    else:
        cells += [(f"g{i}", 10 - i, "void", 9, None) for i in range(5)]
    df = spark.createDataFrame(cells, "row string, row_ord int, col string, col_ord int, value double")
    symbols = spark.createDataFrame([("A", 5), ("B", 7), ("A", 9)], "symbol string, ord int")
    y = spark.createDataFrame([("s0", "no", 3), ("s1", "yes", 1), ("s2", "no", 2), ("void", "x", 0)],
                              "sample_id string, label string, ord int")
    expr, codes = load_labelled(df, y, symbols)
    got = cells_of(expr)
    # Genes in order of their numbers: g4 A, g3 B, g2 A, then no symbols are left.
    assert got["s1", "A"] == (41 + 21) / 2 and got["s1", "B"] == 31 and got["s1", "gene_3"] == 11 and got["s2", "gene_4"] == 2
    assert len(got) == 12
    first = 1  # the label of the column without values came first
    assert sorted((r.sample_id, r.y) for r in codes.collect()) == [("s0", first + 1), ("s1", first), ("s2", first + 1)]
    assert {g for _, g in cells_of(load_labelled(df, y)[0])} == {f"gene_{i}" for i in range(5)}


def test_labelled_matrix_of_nothing(spark):
    df = spark.createDataFrame([], "row string, row_ord int, col string, col_ord int, value double")
    y = spark.createDataFrame([], "sample_id string, label string, ord int")
    expr, codes = load_labelled(df, y)
    assert expr.count() == 0 and codes.count() == 0
    assert expr.select(F.col("gene")).columns == ["gene"]
