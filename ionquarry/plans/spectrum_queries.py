"""Queries of spectrum, text and arithmetic operators. The spectra are the embeddings: peak i at m/z 100 + 10 i, its absolute value as intensity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionquarry.functions import maths as M
from ionquarry.functions import spectrum as S
from ionquarry.functions import text as X
from ionquarry.plans.queries import _r, query

#: Each peak as a row, and each spectrum's order by intensity.
_PK = ", pk AS (SELECT spectrum_id, i, 100.0::DOUBLE + 10 * i AS mz, abs(v) AS y, row_number() OVER (PARTITION BY spectrum_id ORDER BY abs(v) DESC, i) AS r, count(*) OVER (PARTITION BY spectrum_id) AS n, max(abs(v)) OVER (PARTITION BY spectrum_id) AS most FROM (SELECT spectrum_id, unnest(range(len(intensity))) AS i, unnest(intensity) AS v FROM spectra))"


def _peaks() -> Column:
    """The spectrum of a row of the spectra view."""
    return F.transform("intensity", lambda v, i: F.struct((100.0 + 10 * i).cast("double").alias("mz"), F.abs(v).alias("intensity")))


def with_peaks(rows: DataFrame) -> DataFrame:
    return rows.select("spectrum_id", "cluster", _peaks().alias("s"))


@query("spectra", """SELECT spectrum_id, count(*) FILTER (y > 0.1) AS above, round(coalesce(sum(y) FILTER (y > 0.1), 0), 6) AS above_sum, count(*) FILTER (mz BETWEEN 200 AND 400) AS in_range,
  count(*) FILTER (y > cut) AS above_quantile, any_value(cut) AS cut, count(*) FILTER (abs(mz - 300) > 45 OR mz = 300) AS not_co_isolated, count(*) FILTER (mz NOT IN (150, 250)) AS not_removed
  FROM (SELECT *, max(CASE WHEN n - r = least(CAST(floor(n * 0.75) AS INT), n - 1) THEN y END) OVER (PARTITION BY spectrum_id) AS cut FROM pk) GROUP BY 1""", _PK)
def spectrum_filters(rows):
    """Intensity, quantile, range, co-isolation and m/z filters."""
    s = F.col("s")
    above = S.above_intensity(s, 0.1)
    removed = F.array(F.lit(150.0), F.lit(250.0))
    sizes = {"in_range": S.in_range(s, F.lit(200.0), F.lit(400.0)), "above_quantile": S.above_quantile(s, 75), "not_co_isolated": S.without_co_isolated(s, F.lit(300.0), 10, 45.0), "not_removed": S.without_mz(s, removed, 10)}
    return with_peaks(rows).select("spectrum_id", F.size(above).cast("long").alias("above"), _r(S.total(above)).alias("above_sum"), S.quantile(s, 75).alias("cut"), *[F.size(c).cast("long").alias(n) for n, c in sizes.items()])


@query("spectra", """SELECT spectrum_id, count(*) FILTER (abs(mz - 300.001) <= 300.001 * 10 / 1e6) > 0 AS has_mz, arg_max(mz, (y, -i)) FILTER (mz BETWEEN 295 AND 325) AS highest_mz, max(y) FILTER (mz BETWEEN 295 AND 325) AS highest,
  arg_max(mz, (sqrt(y / top) - (mz - 305.0001) * (mz - 305.0001), -i)) FILTER (mz BETWEEN 305.0001 * 0.96 AND 305.0001 * 1.04) AS closest_highest_mz,
  coalesce(arg_min(y, (abs(mz - 304), i)) FILTER (mz BETWEEN 304 * 0.97 AND 304 * 1.03), -1) AS closest, coalesce(max(y) FILTER (mz = 999), -1) AS missing,
  round(max(y) FILTER (mz = 200) / max(y) FILTER (mz = 210), 6) AS ratio, coalesce(max(y) FILTER (mz = 400) / max(y) FILTER (mz = 410) <= 0.05, true) AS monoisotopic
  FROM (SELECT *, max(y) FILTER (mz BETWEEN 305.0001 * 0.96 AND 305.0001 * 1.04) OVER (PARTITION BY spectrum_id) AS top FROM pk) GROUP BY 1""", _PK)
def spectrum_lookups(rows):
    """Peaks by m/z: presence, highest, closest of highest score, closest intensity, ratio, monoisotopic test (a step of ten stands for 13C)."""
    s = F.col("s")
    top = S.highest(S.in_range(s, F.lit(295.0), F.lit(325.0)))
    best = S.closest_highest(s, F.lit(305.0001), 40_000)
    below, own = (S.closest_intensity(s, F.lit(m), 1) for m in (400.0, 410.0))
    return with_peaks(rows).select(
        "spectrum_id", S.has_mz(s, F.lit(300.001), 10).alias("has_mz"), top["mz"].alias("highest_mz"), top["intensity"].alias("highest"), best["mz"].alias("closest_highest_mz"),
        S.closest_intensity(s, F.lit(304.0), 30_000).alias("closest"), S.closest_intensity(s, F.lit(999.0), 1).alias("missing"), _r(S.normalised_intensity(s, F.lit(200.0), F.lit(210.0), 1)).alias("ratio"), (below / own <= 0.05).alias("monoisotopic"),
    )


@query("spectra", """SELECT spectrum_id, array_to_string(list(CAST(mz AS INT) ORDER BY r) FILTER (r <= 5), ',') AS top_mz, round(max(y) FILTER (r = 5), 9) AS fifth, array_to_string(list(CAST(mz AS INT) ORDER BY mz) FILTER (r <= 3), ',') AS top_by_mz,
  count(*) FILTER (y / most > 0.2 AND y / level > 1.5 AND y > 0.05) AS top_peaks FROM (SELECT *, coalesce(max(CASE WHEN r - 1 = CAST(floor(n * 0.8) AS INT) THEN y END) OVER (PARTITION BY spectrum_id), 1) AS level FROM pk) GROUP BY 1""", _PK)
def spectrum_orders(rows):
    """Orders by intensity and m/z, the n most intense peaks, and those above a fraction, a baseline ratio and a least intensity."""
    s = F.col("s")
    listed = lambda c: F.array_join(F.transform(c, lambda p: p["mz"].cast("int").cast("string")), ",")
    ordered = S.by_intensity(s)
    return with_peaks(rows).select("spectrum_id", listed(F.slice(ordered, 1, 5)).alias("top_mz"), _r(F.get(ordered, F.lit(4))["intensity"], 9).alias("fifth"), listed(S.top_n(s, 3)).alias("top_by_mz"), F.size(S.top_peaks(s, 0.2, 1.5, 20, 0.05)).cast("long").alias("top_peaks"))


@query("spectra", """SELECT spectrum_id, '{{' || array_to_string(list(printf('%.3f', mz) ORDER BY i) FILTER (y >= 0.001), ',') || '},{' || array_to_string(list(printf('%.3f', y) ORDER BY i) FILTER (y >= 0.001), ',') || '}}' AS encoded,
  array_to_string(list(printf('%.2f' || chr(9) || '%.2f', mz, y) ORDER BY i) FILTER (y >= 0.01), chr(10)) AS lines, array_to_string(list(printf('[%.4f,%.4f]', mz, y) ORDER BY i), '') AS bracketed, count(*) FILTER (y >= 0.001) AS decoded_peaks, count(*) AS from_bracketed
  FROM pk GROUP BY 1""", _PK)
def spectrum_texts(rows):
    """Encodings of a spectrum as text, and what reading them back gives."""
    s = F.col("s")
    held = with_peaks(rows).select("spectrum_id", S.encoded(s, 3).alias("encoded"), S.encoded(s, 2, table=True).alias("lines"), S.bracketed(s).alias("bracketed"))
    return held.withColumns({"decoded_peaks": F.size(S.decoded(F.col("encoded"))).cast("long"), "from_bracketed": F.size(S.from_bracketed(F.col("bracketed"))).cast("long")})


@query("spectra", """SELECT spectrum_id, array_to_string(list(printf('[%d,%d]', CAST(mz AS INT), CAST(floor(y * 1000) AS INT)) ORDER BY r) FILTER (r <= 4), '') AS signature,
  'BEGIN IONS' || chr(10) || 'TITLE=' || spectrum_id || chr(10) || 'PEPMASS=500.250000' || chr(10) || 'RTINSECONDS=90.000' || chr(10) || 'CHARGE=2+' || chr(10) || array_to_string(list(printf('%.5f %.4f', mz, y) ORDER BY i), chr(10)) || chr(10) || 'END IONS' || chr(10) AS mgf,
  'NAME: ' || spectrum_id || chr(10) || 'PRECURSORMZ: 500.25000' || chr(10) || 'FORMULA: ' || chr(10) || 'Num Peaks: ' || count(*) || chr(10) || array_to_string(list(printf('%.5f %.4f', mz, y) ORDER BY i), chr(10)) || chr(10) AS msp FROM pk GROUP BY spectrum_id""", _PK)
def spectrum_exports(rows):
    """Signature, MGF and MSP records."""
    s, title = F.col("s"), F.col("spectrum_id").cast("string")
    thousand = F.transform(s, lambda p: F.struct(p["mz"].alias("mz"), (p["intensity"] * 1000).alias("intensity")))
    return with_peaks(rows).select("spectrum_id", S.signature(thousand, 4).alias("signature"), S.mgf(s, title, F.lit(500.25), F.lit(1.5), F.lit(2)).alias("mgf"), S.msp(s, title, F.lit(500.25), F.lit(None).cast("string")).alias("msp"))


@query("spectra", """SELECT spectrum_id, count(*) FILTER (mz < 455.5) AS losses, round(min(455.5 - mz) FILTER (mz < 455.5), 6) AS smallest_loss, round(arg_min(y, 455.5 - mz) FILTER (mz < 455.5), 9) AS smallest_intensity, count(*) + count(*) FILTER (mz < 455.5) AS with_losses,
  count(*) FILTER (abs(mz - 290.5) <= 0.001) > 0 AS has_loss, count(*) FILTER (abs(mz - 440) <= 0.001) > 0 AS has_other, round(max(y) / max(most) * 10000, 6) AS scaled_top, round(min(y) / max(most) * 10000, 6) AS scaled_low FROM pk GROUP BY 1""", _PK)
def spectrum_losses(rows):
    """Neutral losses of a precursor at 455.5, and intensities scaled to 10,000."""
    s, precursor = F.col("s"), F.lit(455.5)
    lost, grown = S.neutral_losses(s, precursor), S.scaled(s)
    first = F.get(lost, F.lit(0))
    return with_peaks(rows).select(
        "spectrum_id", F.size(lost).cast("long").alias("losses"), _r(first["mz"]).alias("smallest_loss"), _r(first["intensity"], 9).alias("smallest_intensity"), F.size(S.with_neutral_losses(s, precursor)).cast("long").alias("with_losses"),
        S.has_neutral_loss(s, precursor, 165.0, 3).alias("has_loss"), S.has_neutral_loss(s, precursor, 15.5, 2).alias("has_other"), _r(F.array_max(S.intensities(grown))).alias("scaled_top"), _r(F.array_min(S.intensities(grown))).alias("scaled_low"),
    )


def _log_choose(n: str, k: str) -> str:
    return f"(CASE WHEN {k} <= 0 OR {k} >= {n} THEN 0 ELSE {n} * ({k} / {n}) * ln({n} / {k}) + (1 - {k} / {n}) * ln(1 / (1 - {k} / {n})) END)"


@query("library", f"""SELECT compound_id, round(-({_log_choose("m", "k")} + {_log_choose("(100000 - m)", "(s - k)")} - {_log_choose("100000.0::DOUBLE", "s")}), 6) AS score FROM (
  SELECT compound_id, CAST(compound_id % 9 + 1 AS DOUBLE) AS k, CAST(compound_id % 9 + 3 + compound_id % 5 AS DOUBLE) AS m, CAST(compound_id % 9 + 20 + compound_id % 7 AS DOUBLE) AS s FROM library)""")
def score_hypergeom(rows):
    """Hypergeometric score of k of m library peaks in a spectrum of s peaks."""
    k, c = F.col("compound_id") % 9 + 1, F.col("compound_id")
    return rows.select("compound_id", _r(S.hypergeometric(k, k + 2 + c % 5, k + 19 + c % 7)).alias("score"))


@query("spectra", """SELECT a.spectrum_id, round(sum(sqrt(a.y) * a.mz * a.mz * sqrt(b.y) * b.mz * b.mz) / sqrt(sum(a.y * a.mz ** 4) * sum(b.y * b.mz ** 4)), 6) AS weighted_dot, round(corr(a.y, b.y), 6) AS correlation
  FROM pk a JOIN pk b ON b.spectrum_id = a.spectrum_id + 1 AND a.i = b.i GROUP BY 1""", _PK)
def spectrum_scores(rows):
    """Weighted dot product and correlation of each spectrum and the next."""
    held = with_peaks(rows)
    follow = held.select((F.col("spectrum_id") - 1).alias("spectrum_id"), S.intensities(F.col("s")).alias("next"))
    mz, own = F.transform("s", lambda p: p["mz"]), S.intensities(F.col("s"))
    return held.join(follow, "spectrum_id").select("spectrum_id", _r(S.weighted_dot(mz, own, F.col("next"))).alias("weighted_dot"), _r(M.array_correlation(own, F.col("next"))).alias("correlation"))


@query("spectra", """SELECT spectrum_id, round(avg(y), 9) AS mean, round(var_samp(y), 9) AS variance, round(var_pop(y), 9) AS population, round(median(y), 9) AS median, max(y) FILTER (n - r = CAST(floor((n + 1) / 2) AS INT) - 1) AS lower_median, max(y) FILTER (n - r = 6) AS seventh,
  max(y) FILTER (n - r = least(CAST(floor(n * 0.3 + 0.5) AS INT), n - 1)) AS at_30, count(*) FILTER (y < 0.1) AS below, round(sqrt(sum(y * y)), 9) AS norm FROM pk GROUP BY 1""", _PK)
def array_statistics(rows):
    """Statistics of an array: mean, variances, medians, order statistics, counts."""
    y = F.col("y")
    return with_peaks(rows).select("spectrum_id", S.intensities(F.col("s")).alias("y")).select(
        "spectrum_id", _r(M.mean(y), 9).alias("mean"), _r(M.spread(y), 9).alias("variance"), _r(M.spread(y, True), 9).alias("population"), _r(M.median_or_zero(y), 9).alias("median"), M.lower_median(y).alias("lower_median"),
        M.kth_smallest(y, 6).alias("seventh"), M.at_percentile(y, 30).alias("at_30"), M.count_below(y, F.lit(0.1)).cast("long").alias("below"), _r(F.sqrt(M.dot(y, y)), 9).alias("norm"),
    )


@query("library", """SELECT compound_id, round(abs(precursor_mz + 0.01 - precursor_mz) / (precursor_mz / 1e6), 3) AS ppm, CAST(round(precursor_mz * 1e6) AS BIGINT) AS key, round(CAST(round(precursor_mz * 1e6) AS BIGINT) / 1e6, 6) AS from_key,
  precursor_mz > 905 AND precursor_mz < 910 AS open, precursor_mz BETWEEN 905 AND 910 AS closed, round((precursor_mz + 2 * 1.00727646688) / 2, 6) AS charged, round((precursor_mz - 1.00727646688) / 1, 6) AS negative, round((2 * precursor_mz + 22.98922) / 1, 6) AS dimer,
  round((precursor_mz * 1 - 22.98922) / 2, 6) AS parent, precursor_mz * (1 - 5 / 1e6) < 909.905 AND precursor_mz * (1 + 5 / 1e6) > 909.905 AS within_5, round((precursor_mz + 3) / 3, 6) AS third FROM library""")
def mass_arithmetic(rows):
    """ppm distances, integer keys, intervals, adduct and charge arithmetic."""
    m = F.col("precursor_mz")
    return rows.select(
        "compound_id", _r(M.ppm_distance(m, m + 0.01), 3).alias("ppm"), M.mz_key(m).alias("key"), _r(M.key_mz(M.mz_key(m))).alias("from_key"), M.between_open(m, F.lit(910.0), F.lit(905.0)).alias("open"), M.between_closed(m, F.lit(910.0), F.lit(905.0)).alias("closed"),
        _r(M.adjusted_mass(m, F.lit(2))).alias("charged"), _r(M.adjusted_mass(m, F.lit(-1))).alias("negative"), _r(M.adduct_mass(m, F.lit(2), F.lit(1), F.lit(22.98922))).alias("dimer"), _r(M.parent_mass(m, F.lit(2), F.lit(0), F.lit(22.98922))).alias("parent"),
        M.within_ppm(m, F.lit(909.905), 5).alias("within_5"), _r(F.get(M.charge_series(m, 3), F.lit(2))).alias("third"),
    )


@query("library", """SELECT compound_id, round(exp(lgamma(n + 1) - lgamma(3 + 1) - lgamma(n - 3 + 1))) AS choose_3, round(greatest(0, 100.0::DOUBLE - 0.011 * n * 50), 6) AS corrected,
  round(greatest(0, 100.0::DOUBLE - 90 * exp(lgamma(n + 1) - lgamma(2 + 1) - lgamma(n - 2 + 1)) * pow(0.011, 2) * pow(0.989, n - 2)), 6) AS c13_corrected, round(precursor_mz * (1 - 10 / 1e6), 6) AS mzmin, round((precursor_mz + 1) * (1 + 10 / 1e6), 6) AS mzmax
  FROM (SELECT *, CAST(expected_rt AS INT) + 3 AS n FROM library)""")
def abundance_arithmetic(rows):
    """Binomial coefficients, natural-abundance corrections, isotope windows."""
    n, m = F.col("expected_rt").cast("int") + 3, F.col("precursor_mz")
    window = M.isotope_window(m, F.lit(0.0), m + 1, 10)
    return rows.select("compound_id", M.choose(n, F.lit(3)).alias("choose_3"), _r(M.corrected_abundance(F.lit(100.0), 0.011 * n, F.lit(50.0))).alias("corrected"), _r(M.c13_correction(F.lit(100.0), n, F.lit(2), F.lit(90.0))).alias("c13_corrected"), _r(window["mzmin"]).alias("mzmin"), _r(window["mzmax"]).alias("mzmax"))


@query("library", r"""SELECT compound_id, regexp_replace(regexp_extract('/data/run ' || name || '.mzXML', '([^/]*)$', 1), '\.[^.]*$', '') AS clean, lower(name) = lower(upper(name)) AS same, contains(lower(name), 'part') AS has_part, replace(name, 'a', 'AA') AS replaced, '"' || name || '"' AS quoted,
  CAST(compound_id AS DOUBLE) + 0.5 AS number, 0.0::DOUBLE AS no_number, sha1(name) AS digest, 'x,' || name || ',"b;c",d,"e' AS in_quotes, string_split(category, '#')[1] AS first_part FROM library""")
def text_functions(rows):
    """Names, case, quotes, leading numbers, digests."""
    name = F.col("name")
    return rows.select(
        "compound_id", X.clean_name(F.concat(F.lit("/data/run "), name, F.lit(".mzXML"))).alias("clean"), X.equal_ignoring_case(name, F.upper(name)).alias("same"), X.contains_ignoring_case(name, "PART").alias("has_part"), X.replace_all(name, "a", "AA").alias("replaced"), X.quoted(name).alias("quoted"),
        X.leading_number(F.concat(F.lit("  "), F.col("compound_id").cast("string"), F.lit(".5 Da"))).alias("number"), X.leading_number(name).alias("no_number"), F.sha1(name).alias("digest"), X.replaced_in_quotes(F.concat(F.lit("x,"), name, F.lit(',"b,c",d,"e')), ",", ";").alias("in_quotes"), F.get(F.split("category", "#"), F.lit(0)).alias("first_part"),
    )


@query("library", """SELECT compound_id, printf('(%.2f, %.2f)', precursor_mz, expected_rt + 0.5) AS key, printf('(%.2f, %.2f, %s)', precursor_mz, expected_rt + 0.5, category) AS named_key, precursor_mz AS precursor, expected_rt + 0.5 AS product, 'N' || compound_id AS name, 35.0::DOUBLE AS energy FROM (SELECT compound_id, category, expected_rt, round(precursor_mz, 3) AS precursor_mz FROM library)""")
def filter_lines(rows):
    """What an SRM filter line says: precursor, middle of the product range, name, energy; and keys."""
    m, q3 = F.round("precursor_mz", 3), F.col("expected_rt") + 0.5
    line = F.concat(F.lit("- c ESI SRM ms2 "), F.format_string("%.3f", m), F.lit(" ["), F.format_string("%.3f-%.3f", q3 - 0.25, q3 + 0.25), F.lit("] name=N"), F.col("compound_id").cast("string"), F.lit(" ce=35.0"))
    return rows.select("compound_id", X.srm_key(m, q3).alias("key"), X.srm_key(m, q3, F.col("category")).alias("named_key"), X.srm_precursor(line).alias("precursor"), _r(X.srm_product(line)).alias("product"), X.srm_name(line).alias("name"), X.srm_energy(line).alias("energy"))


@query("library", """SELECT compound_id, CAST(compound_id AS VARCHAR) AS id, name AS named, CASE WHEN compound_id % 2 = 0 THEN 'b' END AS absent, 2 AS entries, 'diagnostic,sn1' AS tags, 'C18:0/' || name AS plain, compound_id % 3 = 0 AS tagged, '{' || least(name, category) || ';' || greatest(name, category) || '}[M+H]+' AS summary_id,
  least(name, category) AS first_name, precursor_mz AS exact_mass, CASE WHEN compound_id % 2 = 0 THEN 'b,g' ELSE 'b,g,x' END AS toggled, 'b,x' AS marked, CASE WHEN compound_id % 2 = 0 THEN '@' ELSE '' END AS cleared FROM library""")
def label_functions(rows):
    """Encoded parameters, fragment label tags, summary identifiers, label sets."""
    c, name = F.col("compound_id"), F.col("name")
    p = X.parameters(F.concat(F.lit("{id="), c.cast("string"), F.lit(";name="), name, F.lit(";=x;"), F.when(c % 2 == 0, "a=b").otherwise("a"), F.lit(";}")))
    label = F.concat(F.lit("*@C18:0/@"), name)
    ids = X.summarized_id(F.array(name, F.col("category"), name), F.lit("[M+H]+"))
    masses = X.exact_mass_adducts(F.concat(F.col("precursor_mz").cast("string"), F.lit(":[M+H]+;x:y")))
    marks = F.when(c % 2 == 0, F.array(F.lit("g"), F.lit("x"), F.lit("b"))).otherwise(F.array(F.lit("g"), F.lit("b")))
    return rows.select(
        "compound_id", p["id"].alias("id"), p["name"].alias("named"), F.try_element_at(p, F.lit("a")).alias("absent"), F.size(X.parameter_list(F.lit("{a;;b}"))).alias("entries"), F.array_join(X.label_tags(label), ",").alias("tags"), X.without_tags(label).alias("plain"),
        X.has_tag(F.when(c % 3 == 0, "$sn").otherwise("sn$"), "sn2").alias("tagged"), ids.alias("summary_id"), F.get(X.summarized_names(ids), F.lit(0)).alias("first_name"), F.get(masses, F.lit(0))["exact_mass"].alias("exact_mass"),
        F.array_join(X.toggled(marks, "x"), ",").alias("toggled"), F.array_join(X.marked(F.array(F.lit("g"), F.lit("x")), "b"), ",").alias("marked"), F.array_join(X.cleared(F.when(c % 2 == 0, F.array(F.lit("@"), F.lit("x"))).otherwise(F.array(F.lit("x")))), ",").alias("cleared"),
    )


@query("library", """SELECT compound_id, 100.5::DOUBLE + compound_id AS mz, expected_rt AS intensity, 'y' || compound_id AS label, '[' || printf('%.2f', expected_rt) || ', ' || printf('%.2f', precursor_mz) || ']' AS floats, 2 AS removed FROM library""")
def msp_lines(rows):
    """Peak lines of a library file, encoded float vectors, lists of m/z."""
    c = F.col("compound_id")
    line = S.msp_peak(F.concat((c + 100.5).cast("string"), F.lit("\t"), F.col("expected_rt").cast("string"), F.lit(' "y'), c.cast("string"), F.lit('"')))
    floats = X.encoded_floats(F.array("expected_rt", "precursor_mz"), 2)
    return rows.select("compound_id", line["mz"].alias("mz"), line["intensity"].alias("intensity"), line["label"].alias("label"), floats.alias("floats"), F.size(X.removed_mz(F.lit("100.5, 200,x"))).alias("removed"))


@query("signal", "SELECT point_id, sample_id, CASE WHEN p IS NULL THEN 0 ELSE rank END AS rank FROM (SELECT point_id, sample_id, CASE WHEN channel = 'view' THEN 1 END AS p, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY intensity DESC, rt, point_id) AS INT) AS rank FROM signal)")
def peak_order_ranks(points):
    """A deterministic order of points with ties settled, used as a rank."""
    rank = F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc("intensity"), "rt", "point_id"))
    return points.select("point_id", "sample_id", F.when(F.col("channel") == "view", rank).otherwise(0).alias("rank"))
