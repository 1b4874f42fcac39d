"""Candidate data files: links of listing pages, filtering, preference order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coterie.functions.columns import contains_any
from coterie.operators.ids import first_per_key

# Fixed values.
PREFER_WORDS = ("matrix", "count", "expr", "norm", "tpm", "fpkm", "rpkm", "log2", "cpm",
                "rawcount", "raw_count", "expression", "quantif")
SKIP_WORDS = ("filelist", "readme", ".md5", "raw.tar", ".tgz", "annotation", "phenotype",
              "metadata", "platform", ".bam", ".bai", ".fastq", "a3ss", "a5ss", "_ri_",
              "se_id", "jc.raw", "junction", "splice", "_jc.", "novel_junc")
SKIP_HOST = "hhs.gov"
FTP_HOST = "ftp://ftp.ncbi.nlm.nih.gov"
HTTPS_HOST = "https://ftp.ncbi.nlm.nih.gov"
LINK_PATTERN = r'(?i)href="([^"?/<>]+\.[a-zA-Z0-9]{1,6})"'


def metadata_links(catalog: DataFrame) -> DataFrame:
    """Clean the metadata entries: no empty or ``none`` ones, the FTP host over
    HTTPS, web addresses only."""
    url = F.regexp_replace("url", r"^\s+|\s+$", "")
    kept = catalog.withColumn("url", url).filter((F.col("url") != "") & (F.lower("url") != "none"))
    https = F.replace("url", F.lit(FTP_HOST), F.lit(HTTPS_HOST))
    return kept.withColumn("url", https).filter(F.col("url").startswith("http"))


def listing_base(accession: Column) -> Column:
    """Folder of an accession: its last three characters become ``nnn``."""
    stem = F.expr("left(accession, length(accession) - 3)")
    return F.concat(F.lit(HTTPS_HOST + "/geo/series/"), stem, F.lit("nnn/"), accession, F.lit("/suppl/"))


def extract_file_links(pages: DataFrame, base: Column | str) -> DataFrame:
    """Relative file names linked from listing pages, as (…, url, pos)."""
    base = F.lit(base) if isinstance(base, str) else base
    names = F.regexp_extract_all("html", F.lit(LINK_PATTERN), F.lit(1))
    keep = [c for c in pages.columns if c != "html"]
    links = pages.select(*keep, base.alias("_base"), F.posexplode(names).alias("pos", "name"))
    relative = ~F.col("name").contains("://") & ~F.lower("name").startswith("http")
    return links.filter(relative).select(*keep, "pos", F.concat("_base", "name").alias("url"))


def rank_candidate_files(catalog: DataFrame) -> DataFrame:
    """Usable candidate files in the order to try them.

    ``catalog(url, source, ord)`` with ``source`` ``metadata`` or ``listing``;
    metadata entries come first.  Files named like something else are dropped,
    of repeated URLs the first stays, URLs that suggest a matrix lead.
    """
    listed = catalog.filter(F.col("source") != "metadata")
    both = metadata_links(catalog.filter(F.col("source") == "metadata")).unionByName(listed)
    file_name = F.lower(F.element_at(F.split("url", "/"), -1))
    usable = both.filter(~contains_any(file_name, SKIP_WORDS) & ~F.col("url").contains(SKIP_HOST))
    place = F.struct((F.col("source") != "metadata").alias("listing"), F.col("ord").alias("ord"))
    unique = first_per_key(usable.withColumn("place", place), "url", "place")
    preferred = contains_any(F.lower("url"), PREFER_WORDS)
    return unique.withColumn("preferred", preferred).orderBy(F.desc("preferred"), "place").drop("place")
