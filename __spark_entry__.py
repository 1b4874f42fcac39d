"""

The inputs are stand-ins built from the given tables: ``embeddings`` as a matrix
of samples x genes with class labels, ``lineitem`` with ``part`` as three data
sets of long cells, ``supplier`` with ``nation`` and ``region`` as metadata,
``pages`` as file listings.  Every query runs over its whole tables.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import numpy as np  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from coterie.operators import (  # noqa: E402
    cluster, consensus, features, figures, fuzzy, ids, impute, kmeans, labels, metrics, neighbors, qc, validate,
)
from coterie.plans import jobs, loaders  # noqa: E402
from coterie.session import cut_lineage, scratch_path, written  # noqa: E402
from coterie.sources import catalog, mappings, matrix, series, sinks  # noqa: E402

try:
    import corpus_pipeline  # noqa: F401
    from coterie.llm import queries as llm_queries
except ImportError:
    llm_queries = None

N_STARTS = 10

# --- inputs on Spark --------------------------------------------------------


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def samples_x(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("features"),
        F.col("label").alias("y"))


def long_x(spark, sf):
    return samples_x(spark, sf).select("sample_id", F.posexplode("features").alias("gene", "value"), "y")


def long_gap(spark, sf):
    """Values below a detection limit are missing."""
    return long_x(spark, sf).withColumn("value", F.when(F.abs("value") >= 0.01, F.col("value")))


def class_of(k, at=0):
    """A clustering that needs no clusterer: which of k features is largest."""
    part = F.slice("features", at + 1, k)
    return (F.array_position(part, F.array_max(part)) - 1).cast("int")


def labels_x(spark, sf, k=3, at=0):
    return samples_x(spark, sf).select("sample_id", class_of(k, at).alias("cluster"))


def base_labels(spark, sf):
    """Three runs of three clusters."""
    x = samples_x(spark, sf)
    runs = F.array(*[F.struct(F.lit(r).alias("run"), class_of(3, 3 * r).alias("cluster")) for r in range(3)])
    return x.select("sample_id", F.explode(runs).alias("c")).select("c.run", "sample_id", "c.cluster")


def k_labels(spark, sf):
    """Runs k = 2, 3, 4 of k clusters each."""
    x = samples_x(spark, sf)
    runs = F.array(*[F.struct(F.lit(k).alias("run"), class_of(k).alias("cluster")) for k in (2, 3, 4)])
    return x.select("sample_id", F.explode(runs).alias("c")).select("c.run", "sample_id", "c.cluster")


def expr3(spark, sf, gene=None):
    """Three data sets of long cells, several rows per cell."""
    gene = F.concat_ws("_", "p_type", "p_size") if gene is None else gene
    return table(spark, sf, "lineitem").join(
        table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_returnflag").alias("dataset"), F.col("l_suppkey").alias("sample_id"),
        gene.alias("gene"), F.col("l_extendedprice").alias("value"))


def fine_gene():
    return F.concat_ws("_", "p_brand", "p_type", "p_size")


def ensembl_id(key):
    return F.concat(F.lit("ENSG"), F.lpad(F.col(key).cast("string"), 11, "0"))


def probe_cells(spark, sf, gene):
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("dataset"), F.col("l_suppkey").alias("sample_id"),
        gene.alias("gene"), F.col("l_extendedprice").alias("value"))


def sample_codes(spark, sf):
    """Integer labels of the samples in each of three data sets, 0-based in each."""
    s = table(spark, sf, "supplier")
    sets = F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R")))
    return s.select(sets.alias("dataset"), F.col("s_suppkey").alias("sample_id"),
                    F.col("s_nationkey").alias("y"), F.col("s_suppkey").alias("ord"))


def metadata(spark, sf):
    s = table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    empty = F.array().cast("array<string>")
    rich = F.col("s_acctbal") > 5000
    return s.select(
        F.col("s_suppkey").alias("sample_id"),
        F.when(rich, F.array("r_name", F.concat(F.lit("Grade: "), F.col("n_name")))).alias("characteristics"),
        F.when(F.col("s_acctbal") > 2000, F.array("n_name")).otherwise(empty).alias("source_name"),
        F.when(F.col("s_acctbal") > 0, F.array("s_name")).alias("title"))


def class_means(spark, sf):
    """Means of all samples by class modulo 3: three centres."""
    rows = long_x(spark, sf).withColumn("y", F.col("y") % 3).groupBy("y", "gene").agg(F.avg("value").alias("c")).collect()
    out = np.zeros((3, 1 + max(r.gene for r in rows)))
    for r in rows:
        out[r.y, r.gene] = r.c
    return out


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def plain(samples: DataFrame) -> DataFrame:
    return samples.select("sample_id", "features")


def y_of(spark, sf):
    return samples_x(spark, sf).select("sample_id", "y")


# --- queries that need more than one line ------------------------------------


def q_read_matrix(spark, sf):
    x = samples_x(spark, sf)
    path = scratch_path(spark, "matrix")
    n = x.select(F.size("features").alias("d")).first().d
    wide = x.select(F.concat(F.lit("g"), F.col("y")).alias("ID"), *[F.col("features")[i].alias(f"s{i}") for i in range(n)])
    wide.write.option("header", True).option("sep", "\t").option("compression", "gzip").csv(path)
    return rounded(matrix.read_matrix(spark, path), "value")


def text_columns(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.regexp_extract("props", r"(\d+)", 1).alias("a"), F.col("event_type").alias("b"),
                    F.when(F.col("event_type") == "error", "NaN").otherwise(F.col("value").cast("string")).alias("c"))


def q_read_gene_info(spark, sf):
    p = table(spark, sf, "part")
    refs = F.concat(F.lit("MIM:"), F.col("p_size"), F.lit("|Ensembl:"), ensembl_id("p_size"),
                    F.lit("|Ensembl:ENSG9"), F.lpad(F.col("p_partkey").cast("string"), 10, "0"))
    line = F.concat_ws("\t", F.lit("9606"), "p_partkey", "p_brand", F.lit("-"), F.lit("-"), refs, F.lit("-"))
    line = F.when(F.col("p_type") == "SMALL", F.concat(F.lit("#"), line)).when(
        F.col("p_type") == "PROMO", F.concat_ws("\t", "p_partkey", "p_brand")).otherwise(line)
    path = scratch_path(spark, "gene-info")
    p.orderBy("p_partkey").select(line.alias("value")).write.option("compression", "gzip").text(path)
    return mappings.read_gene_info(spark, path)


def annotation(spark, sf):
    symbol = F.when(F.col("p_type") == "ECONOMY", "---").when(
        F.col("p_type") == "SMALL", F.concat(F.lit(" "), "p_brand", F.lit(" // x"))).otherwise(
        F.concat("p_brand", F.lit(" /// "), "p_type"))
    return table(spark, sf, "part").select(
        F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")).alias("ID"), symbol.alias("Gene Symbol"),
        F.col("p_partkey").alias("ord"))


def q_detect_columns(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value", "props")
    id_col, value_col = series.detect_columns(e)
    others = [c for c in e.columns if c != id_col]
    shares = matrix.numeric_shares(e, others).drop("n_texts")
    return rounded(shares.withColumn("id_col", F.lit(id_col)).withColumn(
        "is_value", F.col("column") == value_col), "share")


def q_detect_columns_gaps(spark, sf):
    """A value column with missing values beside a wholly numeric one."""
    e = table(spark, sf, "events").select(
        F.col("event_type").alias("ID_REF"), (F.col("value") / 2).alias("DETECTION_P"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("VALUE"))
    id_col, value_col = series.detect_columns(e)
    return rounded(series.pivot_samples(e.withColumn("sample_id", F.lit("all")), id_col, value_col).withColumn(
        "value_col", F.lit(value_col)), "value")


def mixed_probes(spark, sf):
    """Probes of three data sets in file order; only in A are all of them Ensembl IDs,
    and the first of a data set is not the alphabetically first."""
    ensembl = (F.col("l_returnflag") == "A") | (F.col("l_partkey") % 3 == 0)
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    gene = F.when(ensembl, ensembl_id("l_partkey")).otherwise(F.concat(F.lit("AFFX-"), "l_partkey"))
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("dataset"), F.col("l_suppkey").alias("sample_id"), gene.alias("gene"),
        F.col("l_extendedprice").alias("value"), key.alias("ord"))


def wide_x(spark, sf):
    x = samples_x(spark, sf)
    n = x.select(F.size("features").alias("d")).first().d
    g = [F.col("features")[i] for i in range(n)]
    return x.select(F.col("sample_id").alias("vec"), F.col("y").alias("label"),
                    F.concat(F.lit("v"), F.col("sample_id")).alias("name"),
                    *[c.alias(f"g{i}") for i, c in enumerate(g)],
                    F.when(F.abs(g[0]) >= 0.01, g[0]).alias("gaps"), F.lit(None).cast("double").alias("empty"))


def q_drop_null_columns(spark, sf):
    return features.drop_null_columns(wide_x(spark, sf).select("vec", "g0", "gaps", "empty"), "all", keep=("vec",))


def file_catalog(spark, sf):
    p = table(spark, sf, "pages")
    stem = F.concat(F.lit("ftp://ftp.ncbi.nlm.nih.gov/geo/"), F.element_at(F.split("url", "/"), 4), F.lit("/"))
    names = [F.concat(stem, F.col("page_id"), F.lit("_raw_count.txt.gz")), F.concat(stem, F.lit("filelist.txt")),
             F.lit(" none "), F.concat(stem, F.col("page_id"), F.lit(".A3SS.txt")), F.col("url"),
             F.concat(stem, F.lit("series.txt.gz"))]
    meta = p.select(F.posexplode(F.array(*names)).alias("i", "url"), F.lit("metadata").alias("source"),
                    (F.col("page_id") * 10 + F.col("i")).alias("ord"))
    https = F.replace(stem, F.lit(catalog.FTP_HOST), F.lit(catalog.HTTPS_HOST))
    more = [F.concat(https, F.lit("series.txt.gz")), F.concat(https, F.col("page_id"), F.lit(".tsv")),
            F.lit("https://www.hhs.gov/policy/index.html")]
    listing = p.select(F.posexplode(F.array(*more)).alias("i", "url"), F.lit("listing").alias("source"),
                       (F.col("page_id") * 10 + F.col("i")).alias("ord"))
    return meta.select("url", "source", "ord").unionByName(listing.select("url", "source", "ord"))


def q_extract_file_links(spark, sf):
    p = table(spark, sf, "pages")
    html = F.concat("html", F.lit('<a href="p'), "page_id", F.lit('_matrix.txt.gz">'), F.lit('<a href="'), "url",
                    F.lit('">'), F.lit('<A HREF="http:x.gz"><A HREF="Readme.txt">'))
    accession = F.concat(F.lit("GSE"), (F.col("page_id") + 100000).cast("string"))
    pages = p.select("page_id", accession.alias("accession"), html.alias("html"))
    return catalog.extract_file_links(pages, catalog.listing_base(F.col("accession")))


def three_specs(spark, sf):
    cells = expr3(spark, sf)
    codes = sample_codes(spark, sf)

    def broken(_):
        raise ValueError("no processed matrix")

    def one(name):
        return jobs.Dataset(
            name, lambda _: cells.filter(F.col("dataset") == name).drop("dataset"),
            lambda _: codes.filter(F.col("dataset") == name).drop("dataset"))

    return [one("A"), one("N"), jobs.Dataset("missing", broken, broken), one("R")]


def q_load_datasets(spark, sf):
    expr, _, _ = jobs.load_datasets(spark, three_specs(spark, sf))
    return rounded(expr, "value")


def q_load_report(spark, sf):
    expr, _, report = jobs.load_datasets(spark, three_specs(spark, sf))
    sizes = expr.groupBy("dataset").agg(F.count("value").alias("n_cells"))
    return report.join(sizes, "dataset", "left").select("dataset", "loaded", F.coalesce("n_cells", F.lit(0)).alias("n_cells"))


def a_series(spark, sf):
    """A series whose sample tables hold no numbers, with candidate files made from whole
    tables: of those that may be tried, in order, one is not there, one is text, one has
    too few rows, and the fourth is a matrix with a text column and IDs of genes."""
    folder = scratch_path(spark, "series")
    x = samples_x(spark, sf)
    n = x.select(F.size("features").alias("d")).first().d
    cells = [F.col("features")[i].cast("string").alias(f"s{i:02d}") for i in range(n)]
    wide = x.orderBy("sample_id").select(ensembl_id("sample_id").alias("ID"), *cells, F.lit("text").alias("note"))
    regions = table(spark, sf, "region").select("r_regionkey", F.col("r_regionkey").alias("a"), F.col("r_regionkey").alias("b"))
    texts = table(spark, sf, "supplier").select("s_name", F.col("s_name").alias("x"), F.col("s_name").alias("y"))
    for name, df in (("texts_matrix.txt", texts), ("few_matrix.txt", regions), ("good.txt", wide)):
        df.coalesce(1).write.option("header", True).option("sep", "\t").csv(f"{folder}/{name}")
    here = {f"https://h/{name}": f"{folder}/{name}" for name in ("texts_matrix.txt", "few_matrix.txt", "good.txt")}
    urls = ["https://h/good.txt", "https://h/gone_matrix.txt", "https://h/readme.txt", "none", "https://h/texts_matrix.txt",
            "https://h/few_matrix.txt", "https://h/never.txt"]
    listed = spark.createDataFrame([(u, "metadata", i) for i, u in enumerate(urls)], "url string, source string, ord int")
    events = table(spark, sf, "events").select(
        F.col("user_id").alias("sample_id"), F.col("event_type").alias("ID_REF"), F.col("props").alias("note"))
    c = table(spark, sf, "customer")
    meta = c.select(F.format_string("s%02d", "c_custkey").alias("sample_id"), F.array("c_mktsegment").alias("characteristics"),
                    F.array().cast("array<string>").alias("source_name"), F.array("c_name").alias("title"))
    return loaders.Series("S1", [events], listed, meta, annotation(spark, sf), here.get)


def gene_symbols(spark, sf):
    """Every gene ID that ends in the key of a part: the part's name, a probe of ``annotation``."""
    return table(spark, sf, "part").filter("p_type <> 'ECONOMY'").select(
        ensembl_id("p_partkey").alias("id"), F.col("p_name").alias("symbol"))


def q_load_series(spark, sf):
    expr, _, _ = loaders.load_series(spark, a_series(spark, sf), gene_symbols(spark, sf))
    return rounded(expr, "value")


def q_load_series_labels(spark, sf):
    _, y, _ = loaders.load_series(spark, a_series(spark, sf), gene_symbols(spark, sf))
    return y.select("sample_id", "label", "y")


def q_load_series_trace(spark, sf):
    _, _, trace = loaders.load_series(spark, a_series(spark, sf), gene_symbols(spark, sf))
    return trace.select("ord", "source", "name", "used", "outcome")


def labelled(spark, sf):
    """Vectors as rows and dimensions as columns, and labels by vector: the vectors are the
    longer side, so they are the genes and the dimensions the samples."""
    rows = long_x(spark, sf)
    cells = rows.select(F.col("sample_id").alias("row"), F.col("sample_id").alias("row_ord"), F.format_string("d%02d", "gene").alias("col"),
                        F.col("gene").alias("col_ord"), "value")
    empty = rows.where("gene = 0").select(F.col("sample_id").alias("row"), F.col("sample_id").alias("row_ord"),
                                          F.lit("zz").alias("col"), F.lit(999).alias("col_ord"), F.lit(None).cast("double").alias("value"))
    symbols = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("symbol"), F.col("s_suppkey").alias("ord"))
    names = rows.select("gene").distinct().select(F.format_string("d%02d", "gene").alias("sample_id"),
                                                  (F.col("gene") % 7).alias("label"), (-F.col("gene")).alias("ord"))
    return cells.unionByName(empty), names, symbols


def q_load_labelled(spark, sf):
    expr, y = loaders.load_labelled(*labelled(spark, sf))
    return rounded(expr.join(y, "sample_id"), "value")


def q_map_by_position(spark, sf):
    cells = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("sample_id"), F.col("l_partkey").alias("ord"), F.col("l_extendedprice").alias("value"),
        F.lit("").alias("gene"))
    symbols = table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("ord"), F.col("n_name").alias("symbol"))
    return rounded(ids.map_by_position(cells, symbols), "value")


def part_mapping(spark, sf, key):
    return table(spark, sf, "part").filter("p_type <> 'ECONOMY'").select(key.alias("id"), F.col("p_brand").alias("symbol"))


def q_align_labels(spark, sf):
    known = sample_codes(spark, sf).withColumn(
        "sample_id", F.col("sample_id") + F.when(F.col("dataset") == "R", 1_000_000).otherwise(0))
    here = expr3(spark, sf).select("dataset", "sample_id").distinct().withColumn("ord", F.col("sample_id"))
    return ids.align_labels(known, here)


def q_merge_datasets(spark, sf):
    expr, y = qc.merge_datasets(expr3(spark, sf, fine_gene()), sample_codes(spark, sf))
    return rounded(expr.join(y.select("dataset", "sample_id", "y"), ["dataset", "sample_id"]), "value")


def order_labels(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("dataset"), F.col("o_orderkey").alias("sample_id"),
        F.col("o_orderpriority").alias("label"), F.col("o_orderkey").alias("ord"))


def item_rows(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("key"), (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("ord"),
        F.col("l_suppkey").alias("supplier"))


def q_first_per_key(spark, sf):
    rows = item_rows(spark, sf).groupBy("key", "ord").agg(F.min("supplier").alias("supplier"))
    return ids.first_per_key(rows, "key", "ord").select("key", "ord", "supplier")


def q_last_per_key(spark, sf):
    rows = item_rows(spark, sf).groupBy("key", "ord").agg(F.min("supplier").alias("supplier"))
    return ids.last_per_key(rows, "key", "supplier", "ord")


def q_coassociation(spark, sf, scaled=False):
    lab = base_labels(spark, sf)
    out = consensus.scaled_coassociation(lab) if scaled else consensus.coassociation(lab)
    return rounded(out.withColumns({c: F.array_join(c, ",") for c in ("sig_i", "sig_j")}), "co")


def q_coassociation_pairs(spark, sf):
    x = plain(samples_x(spark, sf))
    pairs = neighbors.knn(x, x, 3).select(F.col("sample_id").alias("i"), F.col("neighbor_id").alias("j"))
    return rounded(consensus.coassociation_pairs(base_labels(spark, sf), pairs), "co")


def q_nearest_centre(spark, sf):
    return kmeans.nearest_centre(samples_x(spark, sf), class_means(spark, sf))


def q_fcm(passes):
    def run(spark, sf):
        x = samples_x(spark, sf)
        centres = class_means(spark, sf)
        for _ in range(passes - 1):
            centres = fuzzy.fcm_pass(x, centres)
        u = fuzzy.memberships(x, centres)
        return u.select("sample_id", F.posexplode("u").alias("cluster", "u")).withColumn("u", F.round("u", 6))

    return run


def method_labels(spark, sf):
    return base_labels(spark, sf)


def q_ablation_bars(spark, sf):
    s = metrics.silhouette(plain(samples_x(spark, sf)), method_labels(spark, sf))
    named = s.select(F.concat(F.lit("run "), F.col("run")).alias("method"), "silhouette")
    return rounded(figures.ablation_bars(named), "silhouette")


def q_choose_k(spark, sf):
    s = metrics.silhouette(plain(samples_x(spark, sf)), k_labels(spark, sf))
    return rounded(validate.choose_k(s.withColumnRenamed("run", "k")), "silhouette")


def split_x(spark, sf):
    x = samples_x(spark, sf).select("sample_id", "features", class_of(3).alias("cluster"))
    split = validate.train_test_split(x)
    return split.filter("NOT is_test").drop("is_test"), split.filter("is_test").drop("is_test")


def q_classify(method):
    def run(spark, sf):
        return method(*split_x(spark, sf))

    return run


def reduced(spark, sf):
    """Preprocessed principal components of the whole matrix."""
    chosen = written(features.select_genes(long_x(spark, sf), None, 500).select("sample_id", "gene", "value"))
    return cut_lineage(features.reduce_dim(features.preprocess(chosen)))


def q_pca(spark, sf):
    scores = features.pca(samples_x(spark, sf))
    return scores.select(F.posexplode("features").alias("component", "x")).groupBy("component").agg(
        (F.round(F.avg("x"), 6) + 0.0).alias("mean"), F.round(F.var_samp("x"), 6).alias("variance"))


def q_pca_all(spark, sf):
    """All components: means, total variance and the largest covariance between two."""
    x = samples_x(spark, sf)
    n = x.select(F.size("features").alias("d")).first().d
    scores = written(features.pca(x, n).select("sample_id", F.posexplode("features").alias("component", "x")))
    each = scores.groupBy("component").agg(F.avg("x").alias("mean"), F.var_samp("x").alias("variance"))
    pairs = scores.alias("a").join(scores.alias("b"), "sample_id").where("a.component < b.component").groupBy(
        F.col("a.component").alias("i"), F.col("b.component").alias("j")).agg(F.covar_samp("a.x", "b.x").alias("c"))
    worst = pairs.agg(F.round(F.max(F.abs("c")), 6) + 0.0).scalar()
    return each.agg(F.count(F.lit(1)).alias("n"), (F.round(F.max(F.abs("mean")), 6) + 0.0).alias("mean"),
                    F.round(F.sum("variance"), 6).alias("variance")).withColumn("covariance", worst)


def q_fuzzy_cmeans(spark, sf):
    x = samples_x(spark, sf)
    fit = fuzzy.fuzzy_cmeans(x, 3)
    return fit.memberships(x).select("sample_id", F.posexplode("u").alias("cluster", "u")).withColumn("u", F.round("u", 4))


def q_spectral(spark, sf):
    return cluster.spectral(reduced(spark, sf), 3, n_init=N_STARTS)


def q_write_result(spark, sf):
    path = scratch_path(spark, "result")
    sinks.write_result(ids.dedup_mean(expr3(spark, sf)), path, partition_by=("dataset",))
    return rounded(spark.read.parquet(path), "value")


def q_find_best_k(spark, sf):
    scores = cut_lineage(validate.score_k(reduced(spark, sf), n_init=N_STARTS))
    return rounded(scores.join(validate.choose_k(scores).select("k", F.lit(True).alias("best")), "k", "left").fillna(
        False, ["best"]), "silhouette", digits=4)


def q_run_single(spark, sf):
    return _summary(_through_files(spark, jobs.run_single(
        long_x(spark, sf).select("sample_id", "gene", "value"), y_of(spark, sf), n_init=N_STARTS)))


def q_run_multi(spark, sf):
    return _summary(_through_files(spark, jobs.run_multi(spark, three_specs(spark, sf), n_init=N_STARTS)))


def _through_files(spark, out: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All result tables, figures included, written and read back."""
    path = scratch_path(spark, "results")
    jobs.write_results(out, path)
    return {name: spark.read.schema(df.schema).parquet(f"{path}/{name}") for name, df in out.items()}


def q_knn_hashed(spark, sf):
    """Neighbours by hashing: the share of the exact ones that it finds, over all samples."""
    x = plain(samples_x(spark, sf))
    near = neighbors.knn(x, x, 5, block_rows=256, mode="lsh").select("sample_id", "neighbor_id", F.lit(1).alias("found"))
    exact = neighbors.knn(x, x, 5).select("sample_id", "neighbor_id")
    share = exact.join(near, ["sample_id", "neighbor_id"], "left").agg(F.count(F.lit(1)).alias("n"), F.count("found").alias("found"))
    return share.select("n", (F.col("found") >= 0.5 * F.col("n")).alias("at_least_half"))


# --- planted clusters: three shifts that every method must find ---------------


def planted_x(spark, sf):
    """All samples, every third feature shifted by five, which third by label modulo 3."""
    shifted = F.transform("features", lambda x, i: x + F.when(i % 3 == F.col("y") % 3, 5.0).otherwise(0.0))
    return written(samples_x(spark, sf).select("sample_id", shifted.alias("features"), (F.col("y") % 3).alias("y")))


def q_planted(method):
    def run(spark, sf):
        return method(plain(planted_x(spark, sf)), 3).select("sample_id", "cluster")

    return run


def q_planted_classify(method):
    def run(spark, sf):
        rows = planted_x(spark, sf).withColumnRenamed("y", "cluster").withColumn("cluster", F.col("cluster").cast("int"))
        split = validate.train_test_split(rows)
        return method(split.filter("NOT is_test").drop("is_test"), split.filter("is_test").drop("is_test"))

    return run


def q_planted_classifier_test(spark, sf):
    x = planted_x(spark, sf)
    found = x.select("sample_id", F.col("y").cast("int").alias("cluster"))
    return validate.classifier_test(plain(x), found).select("model", "accuracy", "n_correct", "n_test")


def q_planted_ablation(spark, sf):
    x = planted_x(spark, sf)
    scores = validate.ablation(plain(x), 3, x.select("sample_id", "y"), n_init=N_STARTS)
    return rounded(scores.select("ord", "method", "ari"), "ari")


def q_planted_best_k(spark, sf):
    scores = validate.score_k(plain(planted_x(spark, sf)), n_init=N_STARTS)
    return validate.choose_k(scores).select("k")


def q_planted_run_single(spark, sf):
    """The whole job on planted clusters: agreement with them, and rows of its tables."""
    x = planted_x(spark, sf)
    out = _through_files(spark, jobs.run_single(
        x.select("sample_id", F.posexplode("features").alias("gene", "value")), x.select("sample_id", "y"), n_init=N_STARTS))
    agreed = out["metrics"].select(F.lit("ari").alias("name"), F.round("ari", 6).alias("value"))
    right = out["classifiers"].select(F.concat(F.lit("correct "), "model").alias("name"), F.col("n_correct").cast("double").alias("value"))
    sizes = [out[t].agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(f"rows of {t}").alias("name"), "value")
             for t in ("samples", "labels", "plane", "silhouettes", "ablation", "ablation_bars")]
    rows = agreed.unionByName(right)
    for size in sizes:
        rows = rows.unionByName(size)
    return rows


def _summary(out: dict[str, DataFrame]) -> DataFrame:
    """Metrics, classifiers and ablation as (section, name, value)."""
    def melt(section, df, key, cols):
        pairs = F.explode(F.array(*[F.struct(F.concat_ws(" ", key, F.lit(c)).alias("name"),
                                             F.col(c).cast("double").alias("value")) for c in cols]))
        return df.select(F.lit(section).alias("section"), pairs.alias("p")).select("section", "p.*")

    three = ["silhouette", "davies_bouldin", "ari"]
    parts = melt("metrics", out["metrics"], F.lit("final"), three).unionByName(
        melt("classifiers", out["classifiers"], F.col("model"), ["accuracy", "n_correct", "n_test"])).unionByName(
        melt("ablation", out["ablation"], F.col("method"), three))
    return rounded(parts, "value", digits=4)


def entry(spark: SparkSession) -> DataFrame:
    """The fuzzy ensemble on preprocessed components, evaluated."""
    sf = "/root/testdata/sf0.001"
    samples = reduced(spark, sf)
    found = consensus.fuzzy_ensemble(samples, 3)
    return rounded(metrics.evaluate(samples, found, y_of(spark, sf)), "silhouette", "davies_bouldin", "ari", digits=4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per operator of the inventory, and those of the subpackage if it is there."""
    return core_queries() | (llm_queries.queries() if llm_queries else {})


def core_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        # sources and sinks
        "read_matrix": q_read_matrix,
        "accept_matrix": lambda s, d: matrix.matrix_shape(expr3(s, d)),
        "coerce_numeric": lambda s, d: matrix.coerce_numeric(text_columns(s, d), ["a", "b", "c"]),
        "keep_mostly_numeric": lambda s, d: matrix.keep_mostly_numeric(text_columns(s, d), ["a", "b", "c"]),
        "read_gene_info": q_read_gene_info,
        "read_probe_map": lambda s, d: mappings.read_probe_map(annotation(s, d)),
        "pivot_samples": lambda s, d: rounded(series.pivot_samples(
            table(s, d, "events").withColumnRenamed("user_id", "sample_id"), "event_type", "value"), "value"),
        "detect_columns": q_detect_columns,
        "load_labelled_matrix": lambda s, d: matrix.load_labelled_matrix(wide_x(s, d), "vec", "label"),
        "rank_candidate_files": lambda s, d: catalog.rank_candidate_files(file_catalog(s, d)),
        "extract_file_links": q_extract_file_links,
        "load_datasets": q_load_datasets,
        "load_report": q_load_report,
        "load_series": q_load_series,
        "load_series_labels": q_load_series_labels,
        "load_series_trace": q_load_series_trace,
        "load_labelled": q_load_labelled,
        "write_result": q_write_result,
        # projections and filters
        "qc_filter": lambda s, d: rounded(qc.qc_filter(expr3(s, d)), "value"),
        "drop_null_columns": q_drop_null_columns,
        "select_numeric": lambda s, d: features.select_numeric(table(s, d, "customer")),
        "filter_prefix_id": lambda s, d: ids.starts_with_prefix(probe_cells(s, d, F.when(
            F.col("l_returnflag") == "A", ensembl_id("l_partkey")).otherwise(F.col("l_partkey").cast("string"))),
            "ENSG", "gene", by="dataset"),
        "filter_prefix_id_by_row": lambda s, d: ids.starts_with_prefix(mixed_probes(s, d), "ENSG", "ord", by="dataset"),
        "convert_prefixed_ids_by_row": lambda s, d: rounded(ids.convert_prefixed_ids(
            mixed_probes(s, d), part_mapping(s, d, ensembl_id("p_partkey")), "ord"), "value"),
        "detect_columns_gaps": q_detect_columns_gaps,
        "sample_label_text": lambda s, d: labels.sample_label_text(metadata(s, d)),
        "orient": lambda s, d: matrix.orient(long_x(s, d).select(
            F.col("sample_id").alias("vec"), F.col("gene").alias("dim"), "value"), "vec", "dim"),
        "shift_nonneg": lambda s, d: rounded(features.shift_nonneg(long_x(s, d)), "value"),
        "log1p": lambda s, d: rounded(features.log1p_values(features.shift_nonneg(long_x(s, d))), "value"),
        # joins
        "convert_ids": lambda s, d: rounded(ids.convert_ids(
            probe_cells(s, d, ensembl_id("l_partkey")), part_mapping(s, d, ensembl_id("p_partkey"))), "value"),
        "convert_prefixed_ids": lambda s, d: rounded(ids.convert_prefixed_ids(probe_cells(s, d, F.when(
            F.col("l_returnflag") == "A", ensembl_id("l_partkey")).otherwise(F.col("l_partkey").cast("string"))),
            part_mapping(s, d, ensembl_id("p_partkey")), "gene"), "value"),
        "unmapped_ids": lambda s, d: ids.unmapped_ids(
            probe_cells(s, d, ensembl_id("l_partkey")), part_mapping(s, d, ensembl_id("p_partkey"))),
        "map_probes": lambda s, d: rounded(ids.map_probes(
            probe_cells(s, d, F.col("l_partkey").cast("string")),
            part_mapping(s, d, F.col("p_partkey").cast("string"))), "value"),
        "map_by_position": q_map_by_position,
        "intersect_genes": lambda s, d: rounded(
            ids.dedup_mean(ids.intersect_genes(expr3(s, d, fine_gene()))), "value"),
        "align_labels": q_align_labels,
        "coassociation_pairs": q_coassociation_pairs,
        "knn": lambda s, d: rounded(neighbors.knn(plain(samples_x(s, d)), plain(samples_x(s, d)), 5), "dist"),
        "knn_hashed": q_knn_hashed,
        # aggregations
        "dedup_mean": lambda s, d: rounded(ids.dedup_mean(expr3(s, d)), "value"),
        "dedup_report": lambda s, d: ids.dedup_report(expr3(s, d)),
        "missing_rate_samples": lambda s, d: rounded(qc.missing_rate(ids.dedup_mean(expr3(s, d)), "sample_id"), "missing"),
        "missing_rate_genes": lambda s, d: rounded(qc.missing_rate(ids.dedup_mean(expr3(s, d)), "gene"), "missing"),
        "batch_zscore": lambda s, d: rounded(qc.batch_zscore(written(ids.dedup_mean(expr3(s, d)))), "value"),
        "merge_datasets": q_merge_datasets,
        "label_counts": lambda s, d: labels.label_counts(labels.offset_labels(sample_codes(s, d))),
        "shape_report": lambda s, d: qc.shape_report(expr3(s, d)),
        "merge_diagnosis": lambda s, d: ids.merge_diagnosis(expr3(s, d, fine_gene())),
        "duplicate_cells": lambda s, d: ids.duplicate_cells(expr3(s, d)).withColumnRenamed("count", "n"),
        # order-dependent steps
        "encode_labels": lambda s, d: labels.encode_labels(order_labels(s, d)),
        "offset_labels": lambda s, d: labels.offset_labels(labels.encode_labels(order_labels(s, d))),
        "defuzzify": lambda s, d: labels.defuzzify(
            samples_x(s, d).select("sample_id", F.col("features").alias("u"))),
        "first_per_key": q_first_per_key,
        "last_per_key": q_last_per_key,
        "sort_by_cluster": lambda s, d: figures.sort_by_cluster(labels_x(s, d)),
        "cluster_ranks": lambda s, d: figures.cluster_ranks(labels_x(s, d)),
        # features
        "anova_f": lambda s, d: rounded(features.anova_f(long_x(s, d)), "f"),
        "anova_f_gaps": lambda s, d: rounded(features.anova_f(long_gap(s, d)), "f"),
        "top_k_features": lambda s, d: rounded(features.top_k_features(features.anova_f(long_x(s, d)), 10), "f"),
        "select_genes": lambda s, d: rounded(features.select_genes(long_x(s, d), None, 10), "value"),
        "knn_impute": lambda s, d: rounded(impute.knn_impute(long_gap(s, d).drop("y")), "value"),
        "standardize": lambda s, d: rounded(features.standardize(long_x(s, d)), "value"),
        "variance_threshold": lambda s, d: rounded(features.variance_threshold(long_x(s, d), 0.0155), "value"),
        "minmax_scale": lambda s, d: rounded(features.minmax_scale(
            table(s, d, "part").select("p_partkey", "p_size", "p_retailprice", F.lit(1.0).alias("flat")),
            ["p_size", "p_retailprice", "flat"]), "p_size", "p_retailprice", "flat"),
        "preprocess": lambda s, d: rounded(features.preprocess(long_gap(s, d).drop("y")), "value"),
        "pca": q_pca,
        "pca_all": q_pca_all,
        # clustering
        "kmeans": lambda s, d: kmeans.kmeans(reduced(s, d), 3, n_init=N_STARTS),
        "nearest_centre": q_nearest_centre,
        "ward": lambda s, d: cluster.ward(reduced(s, d), 3),
        "knn_affinity": lambda s, d: neighbors.knn_affinity(plain(samples_x(s, d))),
        "spectral": q_spectral,
        "fuzzy_cmeans": q_fuzzy_cmeans,
        "fuzzy_cmeans_one_pass": q_fcm(1),
        "fuzzy_cmeans_two_passes": q_fcm(2),
        "coassociation": q_coassociation,
        "coassociation_degree": lambda s, d: rounded(consensus.coassociation_degree(base_labels(s, d)), "degree"),
        "scaled_coassociation": lambda s, d: q_coassociation(s, d, scaled=True),
        "fuzzy_consensus": lambda s, d: consensus.fuzzy_consensus(base_labels(s, d), 3, [5.0, 1.0, 1.0]),
        "fuzzy_ensemble": lambda s, d: consensus.fuzzy_ensemble(reduced(s, d), 3, n_init=N_STARTS),
        "hard_ensemble": lambda s, d: consensus.hard_ensemble(reduced(s, d), 3, n_init=N_STARTS),
        # evaluation
        "silhouette_samples": lambda s, d: rounded(
            metrics.silhouette_samples(plain(samples_x(s, d)), labels_x(s, d)), "silhouette"),
        "silhouette": lambda s, d: rounded(metrics.silhouette(plain(samples_x(s, d)), labels_x(s, d)), "silhouette"),
        "silhouette_samples_sqeuclidean": lambda s, d: rounded(metrics.silhouette_samples(
            plain(samples_x(s, d)), labels_x(s, d), metric="sqeuclidean"), "silhouette"),
        "silhouette_sqeuclidean": lambda s, d: rounded(metrics.silhouette(
            plain(samples_x(s, d)), base_labels(s, d), metric="sqeuclidean"), "silhouette"),
        "davies_bouldin": lambda s, d: rounded(
            metrics.davies_bouldin(plain(samples_x(s, d)), labels_x(s, d)), "davies_bouldin"),
        "adjusted_rand": lambda s, d: rounded(metrics.adjusted_rand(y_of(s, d), labels_x(s, d)), "ari"),
        "evaluate": lambda s, d: rounded(
            metrics.evaluate(plain(samples_x(s, d)), base_labels(s, d), y_of(s, d)),
            "silhouette", "davies_bouldin", "ari"),
        "choose_k": q_choose_k,
        "find_best_k": q_find_best_k,
        "train_test_split": lambda s, d: validate.train_test_split(samples_x(s, d)).select("sample_id", "is_test"),
        "classify_rf": q_classify(validate.classify_rf),
        "classify_svm": q_classify(validate.classify_svm),
        "classify_knn": q_classify(validate.classify_knn),
        "classifier_test": lambda s, d: rounded(
            validate.classifier_test(plain(samples_x(s, d)), labels_x(s, d)), "accuracy"),
        "ablation": lambda s, d: rounded(
            validate.ablation(reduced(s, d), 3, y_of(s, d), n_init=N_STARTS),
            "silhouette", "davies_bouldin", "ari", digits=4),
        # planted clusters
        "planted_kmeans": q_planted(lambda x, k: kmeans.kmeans(x, k, n_init=N_STARTS)),
        "planted_ward": q_planted(cluster.ward),
        "planted_ward_summaries": q_planted(lambda x, k: cluster.ward(x, k, mode="summaries", summaries=200)),
        "planted_spectral": q_planted(lambda x, k: cluster.spectral(x, k, n_init=N_STARTS)),
        "planted_fuzzy_cmeans": q_planted(lambda x, k: labels.canonical(labels.defuzzify(
            fuzzy.fuzzy_cmeans(x, k).memberships(x)))),
        "planted_hard_ensemble": q_planted(lambda x, k: consensus.hard_ensemble(x, k, n_init=N_STARTS)),
        "planted_fuzzy_ensemble": q_planted(lambda x, k: consensus.fuzzy_ensemble(x, k, n_init=N_STARTS)),
        "planted_classify_rf": q_planted_classify(validate.classify_rf),
        "planted_classify_svm": q_planted_classify(validate.classify_svm),
        "planted_classifier_test": q_planted_classifier_test,
        "planted_ablation": q_planted_ablation,
        "planted_best_k": q_planted_best_k,
        "planted_run_single": q_planted_run_single,
        # figure tables
        "ablation_bars": q_ablation_bars,
        "heatmap_cells": lambda s, d: rounded(figures.heatmap_cells(plain(samples_x(s, d)), labels_x(s, d)), "value"),
        "project_2d": lambda s, d: rounded(figures.project_2d(plain(samples_x(s, d)), labels_x(s, d)), "x", "y"),
        "project_2d_spectral": lambda s, d: rounded(
            figures.project_2d(plain(samples_x(s, d)), labels_x(s, d), "spectral"), "x", "y", digits=3),
        "silhouette_histogram": lambda s, d: rounded(figures.silhouette_histogram(
            metrics.silhouette_samples(plain(samples_x(s, d)), labels_x(s, d))), "lo", "hi", "mean"),
        # whole jobs
        "run_single": q_run_single,
        "run_multi": q_run_multi,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB twins; iterative and random methods have none."""
    import oracles

    return oracles.statements() | (llm_queries.oracle_sql() if llm_queries else {})
