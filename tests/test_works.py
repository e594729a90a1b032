import io
import xml.etree.ElementTree as ET
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestar.functions import identity as I
from lodestar.functions import strings as S
from lodestar.operators import adapter as A
from lodestar.operators import scores

P1 = """<measure number="0"><attributes><divisions>4</divisions><key><fifths>2</fifths><mode>minor</mode></key><time><beats>6</beats><beat-type>8</beat-type></time></attributes>
<note><pitch><step>D</step><octave>5</octave></pitch><duration>4</duration></note><note><pitch><step>a</step><octave>4</octave></pitch><duration>2</duration></note>
<note><chord/><pitch><step>C</step><alter>1</alter><octave>5</octave></pitch><duration>2</duration><accidental>sharp</accidental></note>
<note><grace/><pitch><step>G</step><octave>4</octave></pitch></note><note><rest/><duration>8</duration></note></measure>
<measure number="1"><attributes><divisions>8</divisions></attributes><direction><words>dolce &amp; calmo</words></direction>
<note><pitch><step>B</step><alter>-1</alter><octave>4</octave></pitch><duration>8</duration><notations><ornaments><turn/><mordent/></ornaments></notations></note></measure>"""
P2 = '<measure><note><pitch><step>F</step><octave>3</octave></pitch><duration>2</duration><voice>2</voice><staff>2</staff></note></measure>'
DUET = f'<score-partwise><part-list><score-part id="P1"/></part-list><part id="P1">{P1}</part><part>{P2}</part></score-partwise>'
# B minor holds D A C# G, not B flat and F; leaps 5, 2, 3; lengths 1, 1/2, 1, 2
EXPECTED = {
    "measure_count": 2, "note_event_count": 7, "pitched_note_count": 6, "rest_fraction": 0.142857, "grace_note_fraction": 0.142857, "note_density_per_measure": 3.0, "mean_midi_pitch": 67.666667,
    "midi_pitch_std": 6.968182, "midi_pitch_range": 21, "pitch_class_entropy_bits": 2.584963, "explicit_accidental_fraction": 0.166667, "out_of_key_note_fraction": 0.333333,
    "chord_tone_fraction": 0.166667, "voice_count": 2, "staff_count": 2, "sounding_note_quarters": 4.5, "rhythmic_entropy_bits": 1.5, "mean_abs_melodic_interval": 3.333333,
    "large_leap_fraction": 0.333333, "ornament_events_per_100_notes": 33.333333, "key_fifths_xml": 2, "key_mode_xml": "minor", "meter_beats_xml": "6", "meter_beat_type_xml": "8",
}


def _one(spark, expression, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(expression(F.col("x"))).collect()]


def _elements(spark, *documents, sources=False):
    rows = spark.createDataFrame([(k, bytearray(d.encode() if isinstance(d, str) else d) if d is not None else None) for k, d in enumerate(documents)], "id long, c binary")
    return scores.elements(rows, "id", "c", sources)


def test_features_of_a_duet(spark):
    table = _elements(spark, DUET, "<score-timewise/>", "no xml", None, DUET.replace("minor", "dorian"), '<score-partwise><part id="x"><measure/></part></score-partwise>')
    got = {r["id"]: r.asDict() for r in scores.features(scores.notes(table, ["id"]), ["id"]).collect()}
    assert sorted(got) == [0, 4]
    assert {k: v for k, v in got[0].items() if k != "id"} == pytest.approx(EXPECTED)
    assert got[4]["out_of_key_note_fraction"] is None
    assert {r["id"] for r in table.filter("error is not null").collect()} == {1, 2, 3}
    assert {r["id"]: (r["parts"], r["measures"]) for r in scores.measure_counts(table, ["id"]).collect()} == {0: (2, 1), 4: (2, 1), 5: (1, 1)}


def test_crop_holds_what_is_in_force(spark):
    attributes = {
        1: "<divisions>2</divisions><clef number='1'><sign>G</sign></clef><clef number='2'><sign>F</sign></clef>", 2: "<clef number='2'><sign>C</sign></clef>", 4: "<key><fifths>3</fifths></key>",
    }
    block = lambda i: f"<attributes>{attributes[i]}</attributes>" if i in attributes else ""
    part = "".join(f'<measure number="X{i}" width="{i} > 0">{block(i)}<note><pitch><step>E</step><octave>{i}</octave></pitch><duration>2</duration></note></measure>' for i in range(1, 7))
    document = f'<?xml version="1.0"?><score-partwise xmlns="urn:s"><work><work-title>T</work-title></work><part id="A">{part}</part><part id="B">{part}<measure/></part></score-partwise>'
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="absent.xml"/><rootfile full-path="inner.xml"/></rootfiles></container>')
        z.writestr("first.xml", "<wrong/>")
        z.writestr("inner.xml", document)
    table = _elements(spark, packed.getvalue(), sources=True)
    windows = spark.createDataFrame([(0, 3, 5), (0, 5, 7), (0, 1, 6)], "id long, bar_start int, bar_end int")
    got = {r["bar_start"]: r for r in scores.crop(table, windows, ["id"]).collect()}
    assert got[5]["document"] is None
    assert (got[3]["first_label"], got[3]["last_label"], got[3]["measures"]) == ("X3", "X5", 3)
    root = ET.fromstring(got[3]["document"])
    at = "{urn:s}"
    for one in root.findall(f"{at}part"):
        measures = one.findall(f"{at}measure")
        assert [m.get("number") for m in measures] == ["X3", "X4", "X5"]
        head = [(e.tag.replace(at, ""), e.get("number"), "".join(e.itertext())) for e in measures[0].find(f"{at}attributes")]
        assert head == [("divisions", None, "2"), ("clef", "1", "G"), ("clef", "2", "C")]
        assert measures[1].find(f"{at}attributes/{at}key/{at}fifths").text == "3" and measures[2].find(f"{at}attributes") is None
        assert [m.find(f"{at}note/{at}pitch/{at}octave").text for m in measures] == ["3", "4", "5"]
    assert root.find(f"{at}work/{at}work-title").text == "T"
    whole = ET.fromstring(got[1]["document"])
    assert [len(p.findall(f"{at}measure")) for p in whole.findall(f"{at}part")] == [6, 6]


def test_key_and_meter_labels(spark):
    row = spark.range(1).select(A.key_label(F.lit(-3), F.lit("")), A.key_label(F.lit(1), F.lit("major")), A.key_label(F.lit(None).cast("int"), F.lit("major")), A.meter_label(F.lit("3"), F.lit("4"))).first()
    assert list(row) == ["E-flat major / C minor key signature", "G major", "unspecified key signature", "3/4"]


def test_catalogue_tokens(spark):
    got = _one(spark, I.catalogue_tokens, "Fantasia, KV 475 (396a)", "Variations, K.264:315d, vol. 7", "Rondo in A minor, K. 511", "Nocturne (72b)")
    assert got == [["475", "396a"], ["264:315d"], ["511"], []]
    assert _one(spark, lambda c: I.catalogue(I.catalogue_tokens(c)), "Sonata, K. 99 (K. 189a)", "Ländler") == ["283", None]


def test_recording_labels(spark):
    a = "Mazurka in B minor, Op. 33: II. Vivace"
    assert _one(spark, I.without_labels, f"{a} - Remastered 2011", f"{a} (Live in Graz)", f"{a} - 1964 Recording", f"{a} -", a) == [a] * 5


def test_movements(spark):
    assert _one(spark, I.movement, "VII", "012.", "4th", "", None, "xx") == ["7", "12", "4", None, None, "xx"]
    assert _one(spark, lambda c: I.movement_in_title(c, F.lit("Mozart")), "K. 457: III. Molto allegro", "Sonatas 5-2", "K. 9") == ["3", "2", None]
    assert _one(spark, lambda c: I.movement_in_title(c, F.lit("Chopin")), "Etude Op. 25 11", "Sonata 3 2nd", "Waltz") == ["11", "2", None]
    assert _one(spark, I.movement_in_path, "/x/2._Adagio/part.mxl", "/x/3rd_take/part.mxl", "/x/K457/part.mxl") == ["2", "3", None]


def test_conflict_of_title_and_path(spark):
    rows = spark.createDataFrame([("g", "Mozart", "Sonata, K. 332: II. B", "/K332/2._B/p.mxl"), ("g", "Mozart", "Sonata, K. 333: II. B", "/K332/2._B/p.mxl")], "g string, n string, t string, p string")
    got = I.group_conflicts(I.with_identity(rows, "n", "t", "p"), "g").first()
    assert (got["numbers"], got["mismatches"], got["conflict"]) == ("332;333", 1, True)


def test_strings(spark):
    assert _one(spark, S.slug, " Étude No. 1! ", "", None, "Łódź ﬁn ½", "e\u0301a", "Ⅳ. ß-Ü") == ["etude-no-1", "none", "none", "odz-fin-1-2", "ea", "iv-u"]
    assert _one(spark, S.ascii_slug, "Étude No. 1", "é", None) == ["tude-no-1", "passage", "passage"]
    assert _one(spark, S.folded, "Straße ÀÉÎÕÜ ñ Ωμέγα", "ＡＢ") == ["strasse aeiou n ωμεγα", "ab"]
    assert _one(spark, I.composer, "Frédéric Chópin", "W. A. MOZART", " Bach, J. S. ", "Liszt", None) == ["Chopin", "Mozart", "Bach", "Liszt", ""]
    assert _one(spark, I.period, "CHÓPIN", "x") == ["Romantic", ""]
    assert _one(spark, S.is_inside, "a/b.xml", "/a", "../a", "a/../b", "") == [True, False, False, False, False]
    assert _one(spark, S.suffix, "a/b.MXL", "a.b/c", ".hidden") == [".mxl", "", ""]
    assert _one(spark, S.truthy, "Yes", "on", "0", None) == [True, True, False, False]
    assert _one(spark, S.whole, "3.0", "7", "x", "") == [3, 7, None, None]
    assert _one(spark, S.license_allows, "CC-BY 4.0", "permitted", "unknown") == [True, True, False]
    assert _one(spark, lambda c: S.folded_contains(c, "CHOPIN"), "Frédéric Chópin", "Bach") == [True, False]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_are_parsed_once(spark):
    rows = spark.createDataFrame([(0, DUET.encode()), (1, b"no xml"), (2, None), (3, b"<score-partwise/>")], "id long, c binary")
    # a crop is read off the row of its score; only the table form gathers elements
    cut = scores.crop(scores.elements(rows, "id", "c", True), spark.createDataFrame([(0, 1, 1), (1, 1, 1)], "id long, bar_start int, bar_end int"), ["id"])
    assert _plan(cut).count("ArrowEvalPython") == 1 and _plan(cut).count("MapInArrow") == 0
    got = {r["id"]: r["document"] for r in cut.collect()}
    assert got[1] is None and got[0].count("<note>") == 6
    whole = scores.parsed(rows, "id", "c", sources=True)
    asked = F.array(F.struct(F.lit(1).alias("bar_start"), F.lit(1).alias("bar_end")))
    own = scores.crops(whole, ["id"], F.col("elements"), asked)
    assert _plan(own).count("ArrowEvalPython") == 1 and "Exchange" not in _plan(own)
    assert {r["id"]: r["document"] for r in own.collect()} == got | {2: None, 3: None}


def test_measures_are_counted_in_the_row(spark):
    documents = [DUET.encode(), b"<score-timewise/>", b"no xml", None, b'<score-partwise><part id="x"><measure/></part><x><measure/></x></score-partwise>', b"<score-partwise/>"]
    rows = spark.createDataFrame(list(enumerate(documents)), "id long, c binary")
    own = scores.counted(scores.parsed(rows, "id", "c", measures_only=True), ["id"])
    assert _plan(own).count("ArrowEvalPython") == 1 and "Exchange" not in _plan(own)
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, scores.measure_counts(scores.elements(rows, "id", "c"), ["id"]).collect())) == [(0, 2, 1), (4, 1, 1)]
    few, full = scores.elements(rows, "id", "c", measures_only=True), scores.elements(rows, "id", "c").filter("tag = '#measure' or error is not null")
    assert sorted(map(tuple, few.drop("ord", "opening").collect()), key=repr) == sorted(map(tuple, full.drop("ord", "opening").collect()), key=repr)


def test_folding_and_identity_are_made_once(spark):
    """Expressions that name a part of theirs several times make it once, so the text of the plan stays short."""
    row = spark.createDataFrame([("Sonata K. 331: II. B", "/K332/2._B/p.mxl")], "t string, p string").withColumn("n", F.lit("x"))
    assert _plan(row.select(S.slug(F.col("t")))).count("translate(") <= 2 and _plan(row.select(I.period(F.col("t")))).count("translate(") <= 2
    assert _plan(row.select(I.catalogue(I.catalogue_tokens(F.col("t"))))).count("regexp_extract_all(") <= 4
    assert _plan(row.select(I.movement_in_path(F.col("p")))).count("regexp_extract(") <= 8
    found = I.with_identity(row, "n", "t", "p")
    both = I.group_conflicts(found, "n", {"open": F.bool_or(I.is_open_instrumentation(F.col("t")))}).first()
    assert (both["numbers"], both["movements"], both["mismatches"], both["conflict"], both["open"]) == ("331", "2", 1, False, False)
    every = [c for c in map(chr, range(0x20, 0x10000)) if not "\ud800" <= c <= "\udfff"]
    ones, bare, several = S._decompositions()
    want = {c: several.get(c, dict(zip(ones, bare)).get(c, c)) for c in every}
    got = dict(spark.createDataFrame([(c,) for c in [*several, *ones, "ж", "a", "…"]], "c string").select("c", S.unaccented(F.col("c"))).collect())
    assert got == {c: want[c] for c in got}
