"""Contacts put into a stored book."""

from pyspark.sql import functions as F

from tidemark.operators import contact_book as B
from tidemark.plans.contact_plans import CHANNEL, EVIDENCE

ROWS = f"at long, given string, organization string, type string, service string, location string, hours string, url string, status string, verified_at timestamp, note string, channels {CHANNEL}, campuses array<string>, evidence {EVIDENCE}"
STORED = {
    "organizations": "id string, name string, type string, aliases array<string>",
    "campuses": "id string, name string",
    "entries": "id string, organization string, service string, location string, hours string, url string, status string, verified_at timestamp, note string, search string",
    "channels": "contact string, priority int, kind string, display string, value string, extension string",
    "places": "contact string, campus string",
    "evidence": "id string, contact string, source string, url string, field string, observed_at timestamp",
}


def row(at, given, organization, **more):
    fields = ("type", "service", "location", "hours", "url", "status", "verified_at", "note", "channels", "campuses", "evidence")
    return (at, given, organization, *(more.get(f) for f in fields))


def imported(spark, rows, **stored):
    return B.imported(spark.createDataFrame(rows, ROWS), **{k: spark.createDataFrame(stored.get(k, []), ddl) for k, ddl in STORED.items()}, root="u")


def test_book(spark):
    rows = [
        row(1, "a", "Alias", service="first", channels=[("phone", "1", "1", None), ("pager", "2", "2", None), (None, None, "3", "9")], campuses=["S", "X", "S"], evidence=[("s", "u", "f", None), ("s", "u", "f", None)]),
        row(2, " a ", "New", service="second", location="room", type="club", channels=None, evidence=[("s", "v", None, None)] + [("s", f"w{i}", "f", None) for i in range(30)]),
        row(3, None, None),
        row(4, "", " ", campuses=[]),
        row(5, "old", "New", service="ignored", channels=[("fax", "x" * 400, "y" * 400, None)]),
    ]
    organizations = [("o2", "Own", "college", ["Alias", "Twin"]), ("o1", "Twin", "office", None), ("o3", "Third", "office", ["Twin"])]
    entries = [("old", "o1", "kept", None, None, None, "x", None, None, ""), ("still", "o1", "still", None, None, None, "x", None, None, "")]
    channels = [("old", 0, "phone", "9", "9", None), ("still", 0, "phone", "8", "8", None)]
    got = imported(spark, rows, organizations=organizations, campuses=[("s", "S")], entries=entries, channels=channels, places=[("old", "s"), ("still", "s")])
    assert [tuple(r) for r in got["counts"].collect()] == [(2, 3)]  # two new entries; a's second row and old; the nameless one's second row
    founded = {(r.name, r.type) for r in got["organizations"].collect()} - {(o[1], o[2]) for o in organizations}
    assert founded == {("New", "office"), (B.UNKNOWN, "office")}
    names = {r.id: r.name for r in got["organizations"].collect()}
    entry = {r.id: r for r in got["entries"].collect()}
    assert len(entry) == 4
    assert (names[entry["a"].organization], entry["a"].service, entry["a"].location, entry["a"].search, entry["a"].status) == ("Own", "first", "room", "New second room", "verified")
    assert (names[entry["old"].organization], entry["old"].service) == ("Twin", "kept")
    (nameless,) = set(entry) - {"a", "old", "still"}
    assert (names[entry[nameless].organization], entry[nameless].service) == (B.UNKNOWN, B.SERVICE)
    kinds = {(r.contact, r.priority, r.kind, len(r.display), len(r.value or "")) for r in got["channels"].collect()}
    assert kinds == {("still", 0, "phone", 1, 1), ("old", 0, "fax", 300, 300)}  # the last row of a has none
    assert {tuple(r) for r in got["places"].collect()} == {("still", "s")}
    assert got["evidence"].where("contact = 'a'").count() == 1 + 20

    # the same list once more changes nothing but the counts
    again = B.imported(spark.createDataFrame(rows, ROWS), **{k: got[k] for k in STORED if k != "campuses"}, campuses=spark.createDataFrame([("s", "S")], STORED["campuses"]), root="u")
    for k in ("organizations", "entries", "channels", "places", "evidence"):
        assert sorted(map(str, again[k].collect())) == sorted(map(str, got[k].collect())), k
    assert [tuple(r) for r in again["counts"].collect()] == [(0, 5)]


def test_empty_list_and_addresses(spark):
    got = imported(spark, [], organizations=[("o", "O", "office", [])], entries=[("e", "o", "s", None, None, None, "x", None, None, "")])
    assert [r.id for r in got["entries"].collect()] == ["e"]
    assert [tuple(r) for r in got["counts"].collect()] == [(0, 0)]
    (served,) = B.reached(got).collect()
    assert (served.organization, served.channels, served.campuses, served.evidence) == ("O", None, None, 0)
    rows = [("phone", "1"), ("email", "a@b"), ("website", "https://x"), ("fax", "1"), ("phone", ""), ("phone", None), (None, "1")]
    urls = spark.createDataFrame(rows, "kind string, value string").select(B.action_url(F.col("kind"), F.col("value")).alias("u"))
    assert [r.u for r in urls.collect()] == ["tel:1", "mailto:a@b", "https://x", None, None, None, None]


def test_matching(spark):
    ddl = "id string, organization string, service string, location string, note string, channels array<struct<priority:int,kind:string,display:string,value:string>>, campuses array<string>"
    rows = [("a", "Office", "Help", None, None, [(0, "phone", "02-1", "0201"), (1, "email", "A@b", None)], ["s"]), ("b", "Desk", None, "Hall", "note", None, None), ("c", None, None, None, None, [], ["g", "s"])]
    served = spark.createDataFrame(rows, ddl)
    ids = lambda *a, **k: sorted(r.id for r in B.matching(served, *a, **k).collect())
    assert ids() == ids(F.lit("")) == ids(F.lit(None).cast("string"), [], []) == ["a", "b", "c"]
    assert ids(F.lit("a@B")) == ids(F.lit("HELP 02-1 a@b")) == ["a"]
    assert ids(F.lit("hall")) == ids(organizations=["Desk"]) == ["b"]
    assert ids(campuses=["g", "x"]) == ["c"] and ids(campuses=["s"]) == ["a", "c"]
    assert ids(F.lit("help"), ["g"]) == ids(F.lit("nowhere")) == []
    with_path = served.withColumn("path", F.when(F.col("id") == "b", F.array(F.lit("Top"), F.lit("Mid"))))
    assert [r.id for r in B.matching(with_path, F.lit("mid top")).collect()] == []
    assert [r.id for r in B.matching(with_path, F.lit("desk top mid hall")).collect()] == ["b"]
