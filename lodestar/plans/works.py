"""Queries on titles, paths and scores made from catalogue rows by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import identity as I
from lodestar.functions import strings as S
from lodestar.operators import scores
from lodestar.plans.catalog import query, table
from lodestar.sources.workspace import materialize

_TITLE = """concat('Piano Sonata No. ', p_partkey % 18 + 1, ', K. ', 280 + p_size, CASE WHEN p_partkey % 5 = 0 THEN ' (189h)' ELSE '' END, CASE WHEN p_partkey % 4 = 3 THEN '' ELSE concat(': ', {roman}, '. Allegro') END,
CASE p_partkey % 3 WHEN 0 THEN ' - Live' WHEN 1 THEN ' (Remastered 1999)' ELSE '' END)"""
_PATH = "concat('/scores/K', 280 + p_partkey % 40, '/', p_partkey % 4 + 1, '._Allegro/score.mxl')"
_ROMAN_DUCK, _ROMAN_SPARK = "(['I', 'II', 'III', 'IV'])[p_partkey % 4 + 1]", "element_at(array('I', 'II', 'III', 'IV'), cast(p_partkey % 4 + 1 as int))"

_WORKS = f"""t AS (SELECT p_partkey, {_TITLE.format(roman=_ROMAN_DUCK)} AS title, {_PATH} AS path FROM part),
x AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(title, '(?i)\\s*-\\s*Live\\b.*$', ''), '(?i)\\s*\\(Remastered[^)]*\\)', '')) AS title, path FROM t),
i AS (SELECT p_partkey, title, CASE WHEN contains(title, '(189h)') THEN '283' ELSE regexp_extract(title, 'K\\. ([0-9]+)', 1) END AS title_number, regexp_extract(path, '/K([0-9]+)/', 1) AS path_number,
CASE WHEN contains(title, ': ') THEN (p_partkey % 4 + 1)::VARCHAR ELSE regexp_extract(path, '/([0-9]+)\\._', 1) END AS movement_number FROM x)"""


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.lit("Wolfgang Amadeus Mozart").alias("name"), F.expr(_TITLE.format(roman=_ROMAN_SPARK)).alias("title"), F.expr(_PATH).alias("path"))


@query("work_identity", f"""WITH {_WORKS} SELECT p_partkey, title AS clean_title, title_number, path_number, movement_number, 'aw_' || substr(sha1(concat_ws(chr(31), 'mozart', title_number, movement_number)), 1, 12) AS work_key FROM i""")
def work_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.with_identity(titles(spark, sf_dir), "name", "title", "path")
    return rows.select("p_partkey", I.without_labels(F.col("title")).alias("clean_title"), "title_number", "path_number", "movement_number", "work_key")


_GROUPS = f"""{_WORKS}, g AS (SELECT p_partkey % 300 AS grp, string_agg(DISTINCT title_number, ';' ORDER BY title_number) AS numbers, string_agg(DISTINCT movement_number, ';' ORDER BY movement_number) AS movements,
count(*) FILTER (title_number <> path_number) AS mismatches, count(DISTINCT title_number) > 1 OR count(DISTINCT movement_number) > 1 AS conflict FROM i GROUP BY grp)"""


@query("group_conflicts", f"WITH {_GROUPS} SELECT grp, numbers, movements, mismatches, 0::BIGINT AS without_number, conflict FROM g")
def group_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.with_identity(titles(spark, sf_dir), "name", "title", "path").withColumn("grp", F.col("p_partkey") % 300)
    return I.group_conflicts(rows, "grp")


@query("expansion_decisions", """WITH p AS (SELECT p_partkey AS p, p_partkey // 2 AS g, p_partkey // 2 % 8 AS c FROM part), g AS (SELECT g, c, count(*) AS m FROM p GROUP BY g, c)
SELECT g AS grp, CASE WHEN c >= 4 AND g % 3 = 0 THEN 'already_represented' WHEN c = 2 OR c = 3 AND m = 2 THEN 'quarantined' WHEN c = 1 THEN 'uncertain' WHEN c = 0 THEN 'ambiguous' ELSE 'approved' END AS decision FROM g""")
def expansion_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on pairs of parts: what is represented is looked up by identity in a selection, the rest is read off titles."""
    p, g = F.col("p_partkey"), F.floor(F.col("p_partkey") / 2)
    rows = table(spark, sf_dir, "part").select(p, g.alias("grp"), (g % 8).alias("c"), F.lit("W. A. Mozart").alias("name"))
    number = lambda n: n.cast("string")
    k = F.when(F.col("c") == 2, F.col("grp") + 2).when(F.col("c") == 3, F.col("grp") + 1 + 9_000_000 * (F.col("p_partkey") % 2)).otherwise(F.col("grp") + 1)
    title = F.when(F.col("c") == 0, "Fantasia").when(F.col("c") == 1, F.concat(F.lit("Concerto in D, K. "), number(k), F.lit(": II. Andante"))).otherwise(F.concat(F.lit("Sonata K. "), number(k), F.lit(": II. Andante - Live")))
    path = F.when(F.col("c") == 2, F.concat(F.lit("scores/K"), number(F.col("grp") + 1), F.lit("/score.mxl"))).otherwise("scores/misc/score.mxl")
    found = I.with_identity(rows.withColumns({"title": title, "path": path}), "name", "title", "path")
    # the selection has other spellings of the same works
    chosen = table(spark, sf_dir, "part").select(g.alias("grp")).distinct().filter("grp % 8 >= 4 and grp % 3 = 0")
    chosen = chosen.select(F.lit("Mozart").alias("name"), F.concat(F.lit("Sonata in C, K "), number(F.col("grp") + 1), F.lit(": 2. (Remastered 2001)")).alias("title"), F.lit("").alias("path"))
    known = I.with_identity(chosen, "name", "title", "path").select("work_key").distinct().withColumn("known", F.lit(True))
    flags = {"represented": F.bool_or(F.col("known").isNotNull()), "open_instrumentation": F.bool_or(I.is_open_instrumentation(F.col("title")))}
    decided = I.group_conflicts(found.join(known, "work_key", "left"), "grp", flags)
    return decided.select("grp", I.decide(decided).alias("decision"))


@query("path_parts", f"""SELECT p_partkey, {_PATH.replace("'/scores", "'scores")} AS path, '.mxl' AS suffix, 'score.mxl' AS file_name, regexp_extract({_PATH.replace("'/scores", "'scores")}, '^(.*)/[^/]*$', 1) AS parent, true AS inside, false AS inside_raw FROM part""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.expr(_PATH.replace("'/scores", "'scores"))
    raw = F.expr(_PATH)
    return table(spark, sf_dir, "part").select("p_partkey", p.alias("path"), S.suffix(p).alias("suffix"), S.file_name(p).alias("file_name"), S.parent(p).alias("parent"), S.is_inside(p).alias("inside"), S.is_inside(raw).alias("inside_raw"))


@query("classified_rows", """SELECT CASE WHEN p_partkey % 11 = 0 THEN 'no_path' WHEN p_partkey % 7 = 0 THEN 'unsupported_midi' WHEN p_partkey % 5 = 0 THEN 'path_escape' WHEN p_size < 5 THEN 'bad_bars' ELSE 'ok' END AS status, count(*) AS n, round(count(*) / (SELECT count(*) FROM part), 4) AS share FROM part GROUP BY status""")
def classified_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered decision list over paths and bars: the first rule that holds."""
    path = F.expr("case when p_partkey % 11 = 0 then '' when p_partkey % 7 = 0 then 'a/b.mid' when p_partkey % 5 = 0 then '../x.xml' else 'a/b.xml' end")
    rows = table(spark, sf_dir, "part").select("p_size", path.alias("path"))
    status = (
        F.when(F.col("path") == "", "no_path").when(S.suffix(F.col("path")).isin(".mid", ".midi"), "unsupported_midi")
        .when(~S.is_inside(F.col("path")), "path_escape").when(F.col("p_size") < 5, "bad_bars").otherwise("ok")
    )
    total = rows.agg(F.count(F.lit(1)).alias("t"))
    counts = rows.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(total).select("status", "n", F.round(F.col("n") / F.col("t"), 4).alias("share"))


@query("rights_and_labels", """SELECT o_orderkey, contains(trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')), 'cc by') OR contains(trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')), 'mit') OR contains(trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')), 'public domain') AS allowed,
CASE WHEN o_orderkey // 3600 > 0 THEN format('{}h{:02d}m{:02d}s', o_orderkey // 3600, o_orderkey % 3600 // 60, o_orderkey % 60) WHEN o_orderkey // 60 > 0 THEN format('{}m{:02d}s', o_orderkey // 60, o_orderkey % 60) ELSE format('{}s', o_orderkey) END AS label
FROM (SELECT o_orderkey, (['CC-BY 4.0', 'permitted', 'unknown', 'Public  Domain'])[o_orderkey % 4 + 1] AS x FROM orders)""")
def rights_and_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.element_at(F.array(*[F.lit(v) for v in ("CC-BY 4.0", "permitted", "unknown", "Public  Domain")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.license_allows(x).alias("allowed"), S.seconds_label(F.col("o_orderkey")).alias("label"))


_STEP = ("C", "D", "E", "F", "G", "A", "B")


def score_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One score per order: a note for every line, two to a measure; divisions double in the third measure."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q"), "l_returnflag")
    when = lambda c, x: F.when(c, x).otherwise("")
    p, k = F.col("l_partkey"), F.col("l_suppkey")
    step = F.element_at(F.array(*[F.lit(s) for s in _STEP]), (p % 7 + 1).cast("int"))
    pitch = F.concat(F.lit("<pitch><step>"), step, F.lit("</step>"), when(k % 3 == 0, "<alter>1</alter>"), F.lit("<octave>"), (p % 3 + 3).cast("string"), F.lit("</octave></pitch>"))
    note = F.concat(
        when(p % 13 == 0, "<grace/>"), F.when(F.col("l_returnflag") == "R", "<rest/>").otherwise(pitch), F.lit("<duration>"), (F.col("q") % 4 + 1).cast("string"), F.lit("</duration><voice>"),
        (p % 2 + 1).cast("string"), F.lit("</voice>"), when(p % 5 == 0, "<accidental>sharp</accidental>"), F.lit("<staff>"), (k % 2 + 1).cast("string"), F.lit("</staff>"),
        when(p % 9 == 0, "<notations><ornaments><trill-mark/></ornaments></notations>"), F.lit("</note>"),
    )
    lines = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", note.alias("x")))).alias("n"))
    key = F.concat(F.lit("<key><fifths>"), (F.col("l_orderkey") % 5 - 2).cast("string"), F.lit("</fifths><mode>"), F.when(F.col("l_orderkey") % 2 == 0, "major").otherwise("minor"), F.lit("</mode></key>"))
    opening = lambda i: F.concat(
        F.lit('<measure number="'), (F.floor(i / 2) + 1).cast("string"), F.lit('">'),
        F.when(i == 0, F.concat(F.lit("<attributes><divisions>2</divisions>"), key, F.lit("<time><beats>3</beats><beat-type>4</beat-type></time></attributes>")))
        .when(i == 4, "<attributes><divisions>4</divisions></attributes>").otherwise(""),
    )
    each = F.transform("n", lambda s, i: F.concat(
        F.when(i % 2 == 0, opening(i)).otherwise(""), F.lit("<note>"), F.when((i % 2 == 1) & (s["l_partkey"] % 4 == 0), "<chord/>").otherwise(""), s["x"],
        F.when((i % 2 == 1) | (i == F.size("n") - 1), "</measure>").otherwise(""),
    ))
    return lines.select("l_orderkey", F.concat(F.lit('<score-partwise version="3.1"><part id="P1">'), F.array_join(each, ""), F.lit("</part></score-partwise>")).alias("content"))


_NOTES = """n AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k, l_partkey AS p, l_suppkey AS s, l_quantity::INT % 4 + 1 AS d, l_returnflag = 'R' AS rest FROM lineitem),
v AS (SELECT *, (k + 1) // 2 AS measure, CASE WHEN NOT rest THEN 12 * (p % 3 + 4) + ([0, 2, 4, 5, 7, 9, 11])[p % 7 + 1] + (s % 3 = 0)::INT END AS midi, d / CASE WHEN k > 4 THEN 4.0 ELSE 2.0 END AS quarters,
k % 2 = 0 AND p % 4 = 0 AS chord, p % 13 = 0 AS grace, l_orderkey % 5 - 2 AS fifths, CASE WHEN l_orderkey % 2 = 0 THEN 'major' ELSE 'minor' END AS mode FROM n),
x AS (SELECT *, CASE WHEN midi IS NOT NULL AND NOT chord THEN abs(midi - lag(midi) OVER (PARTITION BY l_orderkey, p % 2, s % 2, midi IS NOT NULL AND NOT chord ORDER BY k)) END AS leap,
CASE WHEN midi IS NOT NULL AND NOT chord AND NOT grace THEN round(quarters, 6) END AS beat, ((midi - 7 * fifths - CASE WHEN mode = 'minor' THEN 9 ELSE 0 END) % 12 + 12) % 12 AS degree FROM v),
pc AS (SELECT l_orderkey, -sum(p * log2(p)) AS e FROM (SELECT l_orderkey, count(*) / sum(count(*)) OVER (PARTITION BY l_orderkey) AS p FROM x WHERE midi IS NOT NULL GROUP BY l_orderkey, midi % 12) GROUP BY l_orderkey),
be AS (SELECT l_orderkey, -sum(p * log2(p)) AS e FROM (SELECT l_orderkey, count(*) / sum(count(*)) OVER (PARTITION BY l_orderkey) AS p FROM x WHERE beat IS NOT NULL GROUP BY l_orderkey, beat) GROUP BY l_orderkey)"""


@query("score_features", f"""WITH {_NOTES} SELECT x.l_orderkey, max(measure)::INT AS measure_count, count(*) AS note_event_count, count(midi) AS pitched_note_count, round(count(*) FILTER (rest) / count(*), 6) AS rest_fraction, round(count(*) FILTER (grace) / count(*), 6) AS grace_note_fraction,
round(count(midi) / max(measure), 6) AS note_density_per_measure, round(avg(midi), 6) AS mean_midi_pitch, round(stddev_pop(midi), 6) AS midi_pitch_std, (max(midi) - min(midi))::BIGINT AS midi_pitch_range, round(abs(coalesce(any_value(pc.e), 0)), 6) AS pitch_class_entropy_bits,
round(count(*) FILTER (midi IS NOT NULL AND p % 5 = 0) / count(midi), 6) AS explicit_accidental_fraction, round(avg(CASE mode WHEN 'minor' THEN degree NOT IN (0, 2, 3, 5, 7, 8, 10) ELSE degree NOT IN (0, 2, 4, 5, 7, 9, 11) END::INT) FILTER (midi IS NOT NULL), 6) AS out_of_key_note_fraction,
round(count(*) FILTER (midi IS NOT NULL AND chord) / count(midi), 6) AS chord_tone_fraction, count(DISTINCT p % 2) AS voice_count, count(DISTINCT s % 2) AS staff_count, round(coalesce(sum(beat), 0), 6)::DOUBLE AS sounding_note_quarters, round(abs(coalesce(any_value(be.e), 0)), 6) AS rhythmic_entropy_bits,
round(coalesce(avg(leap), 0), 6) AS mean_abs_melodic_interval, round(coalesce(count(*) FILTER (leap >= 5) / nullif(count(leap), 0), 0), 6) AS large_leap_fraction, round(100 * count(*) FILTER (midi IS NOT NULL AND p % 9 = 0) / count(midi), 6) AS ornament_events_per_100_notes,
any_value(fifths)::INT AS key_fifths_xml, any_value(mode) AS key_mode_xml, '3' AS meter_beats_xml, '4' AS meter_beat_type_xml
FROM x LEFT JOIN pc ON pc.l_orderkey = x.l_orderkey LEFT JOIN be ON be.l_orderkey = x.l_orderkey GROUP BY x.l_orderkey HAVING count(midi) > 0""")
def score_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores are parsed from XML; the SQL computes the same features from the rows that the XML was made of."""
    played = scores.notes(scores.elements(score_documents(spark, sf_dir), "l_orderkey", "content"), ["l_orderkey"])
    return scores.features(played, ["l_orderkey"]).withColumn("midi_pitch_range", F.col("midi_pitch_range").cast("long"))


@query("score_measures", "SELECT l_orderkey, 1::BIGINT AS parts, ((count(*) + 1) // 2)::INT AS measures FROM lineitem GROUP BY l_orderkey")
def score_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.counted(scores.parsed(score_documents(spark, sf_dir), "l_orderkey", "content", measures_only=True), ["l_orderkey"])


@query("score_crops", f"""WITH {_NOTES}, m AS (SELECT l_orderkey, max(measure) AS measures FROM v GROUP BY l_orderkey), w AS (SELECT l_orderkey, measures, unnest([2, 3]) AS bar_start FROM m)
SELECT w.l_orderkey, bar_start::INT AS bar_start, CASE WHEN measures > bar_start THEN bar_start::VARCHAR END AS first_label, CASE WHEN measures > bar_start THEN (bar_start + 1)::VARCHAR END AS last_label, CASE WHEN measures > bar_start THEN 2 END::INT AS measures,
count(v.k) AS notes, any_value(fifths)::INT AS fifths, any_value(mode) AS mode, round(sum(quarters), 6)::DOUBLE AS quarters FROM w LEFT JOIN v ON v.l_orderkey = w.l_orderkey AND measures > bar_start AND measure BETWEEN bar_start AND bar_start + 1 GROUP BY w.l_orderkey, bar_start, measures""")
def score_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two windows of two measures of each score, cut from the document, read again and summed up."""
    whole = scores.parsed(score_documents(spark, sf_dir), "l_orderkey", "content", sources=True)
    readable = F.exists("elements", lambda x: x["tag"] == "#head")
    asked = F.when(readable, F.array(*[F.struct(F.lit(k).alias("bar_start"), F.lit(k + 1).alias("bar_end")) for k in (2, 3)]))
    cut = scores.crops(whole, ["l_orderkey"], F.col("elements"), asked).withColumn("id", F.concat_ws(":", "l_orderkey", "bar_start"))
    cut = materialize(cut, "crops")  # they are read twice, and cut once
    played = scores.notes(scores.elements(cut.filter("document is not null"), "id", "document"), ["id"])
    sums = played.groupBy("id").agg(F.count(F.lit(1)).alias("notes"), F.first("fifths").alias("fifths"), F.first("mode").alias("mode"), F.round(F.sum("quarters"), 6).alias("quarters"))
    return cut.join(sums, "id", "left").fillna(0, ["notes"]).select("l_orderkey", "bar_start", "first_label", "last_label", F.col("measures").cast("int").alias("measures"), "notes", "fifths", "mode", "quarters")
