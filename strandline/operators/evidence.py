"""Joining variants with annotation sources, metadata merging, report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..scale import first_row
from ..session import stored

# Annotation fields copied onto a variant, and the names they take.
COPIED = {
    "overall_frequency_n": "num", "overall_frequency_d": "denom", "qualified_impact": "qualified_impact", "impact": "impact",
    "in_omim": "in_omim", "in_pharmgkb": "in_pharmgkb", "in_gwas": "in_gwas", "summary_short": "summary_short",
    "variant_quality": "variant_quality", "quality_scores": "quality_scores", "max_or_disease_name": "max_or_disease_name",
    "max_or_or": "max_or_or", "pph2_score": "pph2_score", "genetests_testable": "genetests_testable",
    "genetests_reviewed": "genetests_reviewed", "gene_in_genetests": "gene_in_genetests", "suff_eval": "suff_eval",
}
# Quality categories in order.
QUALITIES = ("in_silico", "in_vitro", "case_control", "familial", "severity", "treatability", "penetrance")
# Three-letter amino acids and their letters.
AMINO = {"Ala": "A", "Arg": "R", "Asn": "N", "Asp": "D", "Cys": "C", "Gln": "Q", "Glu": "E", "Gly": "G", "His": "H", "Ile": "I",
         "Leu": "L", "Lys": "K", "Met": "M", "Phe": "F", "Pro": "P", "Ser": "S", "Thr": "T", "Trp": "W", "Tyr": "Y", "Val": "V",
         "Xaa": "X", "Stop": "X"}


def evidence_refresh(variants: DataFrame, latest: DataFrame, id: str = "variant_id") -> DataFrame:
    """Overlay fields of the newest annotation on variants.

    `variants` has gene, amino_acid_change, dbsnp (comma separated); `latest`
    has gene, aa_change_short, dbsnp_id, ord and any of the copied fields. The
    match is by (gene, change with * as X), else by the first listed rs number
    found; the last annotation row of a key wins.
    """
    fields = [c for c in latest.columns if c in COPIED or c.startswith("qualityscore_")]
    payload = F.struct(*[F.col(c) for c in fields], F.lit(True).alias("_hit"))
    by_aa = (latest.where("aa_change_short is not null").groupBy("gene", F.col("aa_change_short").alias("_aa"))
             .agg(F.max_by(payload, "ord").alias("_by_aa")))
    by_rs = latest.where("dbsnp_id is not null").groupBy(F.col("dbsnp_id").alias("_rs")).agg(F.max_by(payload, "ord").alias("_p"))
    wanted = variants.select(id, F.posexplode(F.split("dbsnp", ",")).alias("_i", "_rs")).join(by_rs, "_rs").groupBy(id).agg(
        F.min_by("_p", "_i").alias("_by_rs"))
    j = (variants.withColumn("_aa", F.replace("amino_acid_change", F.lit("*"), F.lit("X")))
         .join(by_aa, ["gene", "_aa"], "left").join(wanted, id, "left").withColumn("_m", F.coalesce("_by_aa", "_by_rs")))
    hit = F.col("_m._hit").isNotNull()
    out = {"refreshed": F.when(hit, "Y").otherwise("N")}
    for src, name in COPIED.items():
        if src in fields:
            old = F.col(name) if name in variants.columns else F.lit(None)
            out[name] = F.coalesce(F.col(f"_m.{src}"), old)
    impact = out.get("qualified_impact", F.col("qualified_impact") if "qualified_impact" in variants.columns else F.lit(None))
    judged = ~F.coalesce(impact.rlike("(?i)insufficiently evaluated"), F.lit(False))
    kept = F.col("suff_eval") if "suff_eval" in variants.columns else F.lit(None).cast("boolean")
    newest = F.col("_m.suff_eval") if "suff_eval" in fields else F.lit(None).cast("boolean")
    out["suff_eval"] = F.when(hit, F.coalesce(newest, judged)).otherwise(kept)
    scores = [F.coalesce(F.col(f"_m.qualityscore_{q}").cast("string"), F.lit("-")) if f"qualityscore_{q}" in fields else F.lit("-") for q in QUALITIES]
    derived = {"quality_scores": F.concat_ws(",", *scores), "variant_quality": F.concat(*scores)}
    known = F.col("_m.quality_scores") if "quality_scores" in fields else F.lit(None).cast("string")
    for name, value in derived.items():
        had = F.col(name) if name in variants.columns else F.lit(None).cast("string")
        copied = F.coalesce(F.col(f"_m.{name}") if name in fields else F.lit(None).cast("string"), had)
        out[name] = F.when(hit & known.isNull(), value).when(hit, copied).otherwise(had)
    return j.withColumns(out).select(*variants.columns, *[c for c in out if c not in variants.columns])


def _short_amino(col) -> Column:
    name = F.initcap(col)
    table = F.create_map(*[F.lit(x) for kv in AMINO.items() for x in kv])
    return F.coalesce(F.element_at(table, name), name)


def allele_frequencies(freq: DataFrame, build: str | None = None) -> DataFrame:
    """One row per allele: (ord, name, chr, pos, allele, freq, detail).

    `freq` has place (`chr:pos`), dbsnp, alleles (`A=3/C=5`), gene, function,
    aa (comma list, the reference last), aapos (`12/300`), detail, ord. Coding
    changes are named `gene A12T`, others by rs number or build and place.
    """
    silent = F.col("function").rlike("^(coding-syn|intron|utr-|near-gene-|intergenic)")
    aa = F.split("aa", ",")
    to = F.slice(aa, 1, F.size(aa) - 1)
    at = F.split_part("aapos", F.lit("/"), F.lit(1))
    coding = F.transform(to, lambda x: F.concat("gene", F.lit(" "), _short_amino(F.element_at(aa, -1)), at, _short_amino(x)))
    names = F.when(~silent, coding).when(F.col("dbsnp") != "none", F.array("dbsnp"))
    if build:
        names = names.otherwise(F.array(F.concat(F.lit(build + ":"), "place")))
    pairs = F.transform(F.split("alleles", "/"), lambda s: F.struct(
        F.split_part(s, F.lit("="), F.lit(1)).alias("a"), F.split_part(s, F.lit("="), F.lit(2)).cast("long").alias("n")))
    rows = freq.withColumns({"_names": names, "_pairs": pairs}).where("_names is not null")
    total = F.aggregate("_pairs", F.lit(0).cast("long"), lambda acc, p: acc + p["n"])
    each = rows.withColumn("_total", total).select("ord", "place", "detail", "_names", "_total", F.posexplode("_pairs").alias("_i", "p"))
    return each.select("ord", "_i", F.get("_names", F.col("_i")).alias("name"),
                       F.concat(F.lit("chr"), F.split_part("place", F.lit(":"), F.lit(1))).alias("chr"),
                       F.split_part("place", F.lit(":"), F.lit(2)).cast("long").alias("pos"), F.col("p.a").alias("allele"),
                       F.when(F.col("_total") > 0, F.round(F.col("p.n") / F.col("_total"), 9)).alias("freq"), "detail")


def allele_freq_join(variants: DataFrame, freq: DataFrame, build: str | None = None) -> DataFrame:
    """Attach `esp_freq` and `esp_detail` to variants named `gene change`; the last frequency row of a name wins."""
    named = allele_frequencies(freq, build).where("name is not null").withColumn("_o", F.struct("ord", "_i"))
    best = first_row(named.select("name", "freq", "detail", "_o"), ["name"], "_o", last=True).select(
        F.col("name").alias("_name"), F.col("freq").alias("esp_freq"), F.col("detail").alias("esp_detail"))
    key = F.concat("gene", F.lit(" "), "amino_acid_change")
    # Variants without a name go around the join, so that they don't meet in one partition.
    named_rows = variants.where(key.isNotNull()).join(best, key == F.col("_name"), "left").drop("_name")
    kinds = {f.name: f.dataType for f in best.schema.fields}
    return named_rows.unionByName(variants.where(key.isNull()).withColumns(
        {c: F.lit(None).cast(kinds[c]) for c in ("esp_freq", "esp_detail")}))


def annotate_counts(tumor: DataFrame, normal: DataFrame, repeats: DataFrame) -> DataFrame:
    """Per tumor key: its count, the normal count (0 if missing), annotations joined by `|` or NA."""
    names = repeats.select("key", "value").distinct().groupBy("key").agg(
        F.concat_ws("|", F.array_sort(F.collect_list("value"))).alias("annotation"))
    return (tumor.select("key", F.col("n").alias("tumor")).join(normal.select("key", F.col("n").alias("normal")), "key", "left")
            .join(names, "key", "left").select(F.coalesce("annotation", F.lit("NA")).alias("annotation"), "key", "tumor",
                                               F.coalesce("normal", F.lit(0)).alias("normal")))


def pair_samples(normal: DataFrame, tumor: DataFrame, name: str = "name") -> DataFrame:
    """Zip two chunk lists by name; a name on one side only is an error when the rows are read."""
    n = normal.select(name, *[F.col(c).alias(f"normal_{c}") for c in normal.columns if c != name], F.lit(1).alias("_n"))
    t = tumor.select(name, *[F.col(c).alias(f"tumor_{c}") for c in tumor.columns if c != name], F.lit(1).alias("_t"))
    j = n.join(t, name, "full")
    checked = F.when(F.col("_n").isNull() | F.col("_t").isNull(),
                     F.raise_error(F.concat(F.lit("unpaired chunk "), F.col(name).cast("string")))).otherwise(F.col(name))
    return j.withColumn(name, checked).drop("_n", "_t")


def evidence_by_chromosome(parts: DataFrame, part: str = "part_chr", chr: str = "chr") -> DataFrame:
    """Recombine per-chromosome results, keeping of each part only its own chromosome's rows."""
    return parts.where(F.col(part) == F.col(chr)).drop(part)


def _follow(nodes: DataFrame) -> DataFrame:
    """(ord, up, odd) with `up` moved to the end of its chain and `odd` the parity of the steps, by pointer doubling."""
    while True:
        ahead = nodes.select(F.col("ord").alias("_o"), F.col("up").alias("_up"), F.col("odd").alias("_odd"))
        moved = stored(nodes.join(ahead, F.col("up") == F.col("_o")).select(
            "ord", F.col("_up").alias("up"), (F.col("odd") != F.col("_odd")).alias("odd"), (F.col("up") != F.col("_up")).alias("_moved")), "chains")
        nodes = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return nodes


def accepted_inputs(inputs: DataFrame) -> DataFrame:
    """Ids (ord) of the inputs to merge: one is skipped when an earlier accepted one has a chromosome of its own.

    `inputs` is (ord, chr) rows; those without an ord or a chr say nothing.
    An input that is first on all of its chromosomes is accepted. One that
    waits for a single other input is accepted if that one isn't, so chains of
    such inputs are followed to their ends by pointer doubling and settled by
    the parity of their length: a chain of n clashes takes about log2(n) steps.
    Then all that clash with an accepted input leave, and the rest goes on. The
    two first inputs of a chromosome tell all this; no pairs of inputs are made.
    """
    left, taken = stored(inputs.where("ord is not null and chr is not null").select("ord", "chr").distinct(), "inputs"), None
    nobody = left.select("ord").limit(0)
    while not left.isEmpty():
        first = left.groupBy("chr").agg(F.min("ord").alias("_first"))
        ranked = left.join(first, "chr")
        second = ranked.where("ord > _first").groupBy("chr").agg(F.min("ord").alias("_second"))
        behind = F.when(F.col("ord") > F.col("_first"), F.col("_first"))
        nodes = ranked.join(second, "chr", "left").groupBy("ord").agg(
            F.min(behind).alias("_low"), F.max(behind).alias("_high"), F.max(F.coalesce(F.col("ord") > F.col("_second"), F.lit(False))).alias("_far"))
        free = F.col("_low").isNull()
        waits = ~free & ~F.col("_far") & (F.col("_low") == F.col("_high"))
        nodes = stored(nodes.select("ord", F.when(waits, F.col("_low")).otherwise(F.col("ord")).alias("up"), waits.alias("odd"), free.alias("free")), "waits")
        ends = nodes.where("free").select(F.col("ord").alias("up"))
        ok = stored(_follow(nodes.drop("free")).where("not odd").join(ends, "up", "left_semi").select("ord"), "accepted")
        used = left.join(ok, "ord", "left_semi").select("chr").distinct()
        gone = left.join(used, "chr", "left_semi").select("ord").distinct()
        left = stored(left.join(gone, "ord", "left_anti"), "inputs")
        taken = ok if taken is None else taken.unionByName(ok)
    return nobody if taken is None else taken


def merge_metadata(lines: DataFrame, json: str = "json") -> DataFrame:
    """Merge JSON objects (ord, json) by key: long rows (key, kind, ord, i, value).

    Arrays concatenate (one row per element, in order), integers add, strings
    give their distinct values in order of appearance, objects are ignored.
    `called_frac_*` rows are match_num over each ref_*_num.
    """
    keyed = lines.withColumn("_m", F.from_json(json, "map<string,string>"))
    chroms = keyed.select("ord", F.explode(F.from_json(F.col("_m")["chromosomes"], "array<string>")).alias("chr"))
    kept = keyed.join(accepted_inputs(chroms), "ord", "left_semi")
    items = kept.select("ord", F.explode("_m").alias("key", "v"))
    array_, object_, number = F.col("v").startswith("["), F.col("v").startswith("{"), F.col("v").rlike("^[0-9]+$")
    arrays = items.where(array_).select("key", F.lit("array").alias("kind"), "ord", F.posexplode(F.from_json("v", "array<string>")).alias("i", "value"))
    sums = items.where(number).groupBy("key").agg(F.sum(F.col("v").cast("long")).alias("s"))
    numbers = sums.select("key", F.lit("number").alias("kind"), F.lit(None).cast("long").alias("ord"), F.lit(0).alias("i"), F.col("s").cast("string").alias("value"))
    strings = items.where(~array_ & ~object_ & ~number).groupBy("key", F.col("v").alias("value")).agg(F.min("ord").alias("ord")).select(
        "key", F.lit("string").alias("kind"), "ord", F.lit(0).alias("i"), "value")
    refs = sums.where(F.col("key").rlike("^ref_.*_num$"))
    match = sums.where("key = 'match_num'").agg(F.max("s").alias("s")).scalar()
    frac = refs.withColumn("_match", match).where("_match is not null").select(
        F.regexp_replace("key", "^ref_(.*)_num$", "called_frac_$1").alias("key"), F.lit("ratio").alias("kind"), F.lit(None).cast("long").alias("ord"),
        F.lit(0).alias("i"), F.round(F.col("_match") / F.col("s"), 6).cast("string").alias("value"))
    return arrays.unionByName(numbers).unionByName(strings).unionByName(frac)


def chromosome_metadata(lines: DataFrame, json: str = "json") -> DataFrame:
    """The last single-chromosome input of each chromosome."""
    c = F.from_json(F.get_json_object(json, "$.chromosomes"), "array<string>")
    one = lines.withColumn("_c", c).where(F.size("_c") == 1).select(F.get("_c", F.lit(0)).alias("chr"), "ord", F.col(json).alias("json"))
    return first_row(one, ["chr"], "ord", last=True)


def align_by_rownum(tables: dict[str, DataFrame], row: str = "row_no") -> DataFrame:
    """Side-by-side join of statistics tables by row number, titles prefixed by the table's name."""
    out = None
    for name, df in tables.items():
        t = df.select(row, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != row])
        out = t if out is None else out.join(t, row, "full")
    return out


def summary_table(stats: DataFrame, genome_fraction: float = 0.0675, row: str = "row_no") -> DataFrame:
    """Accuracy, coverage and per-megabase rates per row (con, dis, nocall, het_n, het_y), and a Sum row (`row` NULL)."""
    called = F.col("con") + F.col("dis")
    tried = called + F.col("nocall")
    cov = F.when(tried > 0, 100 * called / tried).otherwise(0.0)
    extrapolated = genome_fraction * cov
    per_mb = lambda c: F.when(extrapolated > 0, F.col(c) * 30 / extrapolated).otherwise(0.0)
    rows = stats.withColumns({"accuracy": F.when(called > 0, 100 * F.col("con") / called).otherwise(0.0), "coverage": cov, "mb": extrapolated,
                              "het_n_mb": per_mb("het_n"), "het_y_mb": per_mb("het_y")})
    cols = [c for c in rows.columns if c != row]
    return rows.rollup(row).agg(*[F.round(F.sum(c), 2).alias(c) for c in cols])
