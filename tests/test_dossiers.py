"""Page evidence to dossiers, and streamed crawl drops against the same drops in batches."""

from placeledger.operators import ingest as ig
from placeledger.operators import pages as pg
from placeledger.plans import queries_resolve as qr
from placeledger.plans.registry import all_queries
from placeledger.plans.views import AS_OF, Directory

PAGES = [
    ("s1", 1, "https://a.example.com/", 200, "<title> A &amp; B </title><p>We sell Pokémon and comics in our friendly little shop.</p>"
                                             '<a href="/events?x=1">Our events</a><p>Call 555-010-1234</p>'),
    ("s1", 2, "https://a.example.com/b", 200, '<meta name="description" content="Second page with a long description"><p>Board games. Mon: 10 am</p>'
                                              '<script type="application/ld+json">{"@type": "Store"}</script>'),
    ("s2", 1, "https://b.example.com/", 200, "<p>nothing here</p>"),
]


def test_dossiers(spark):
    pages = spark.createDataFrame(PAGES, "store_id string, page_no int, url string, status_code int, html string")
    evidence = pg.page_extract(pages)
    one = evidence.filter("store_id = 's1' AND page_no = 1").first()
    assert (one.title, one.products, one.phones) == ("A & B", ["comics", "pokemon"], ["555-010-1234"])
    assert one.event_urls == ["https://a.example.com/events"] and one.event_types == ["events"]
    assert one.description == "We sell Pokémon and comics in our friendly little shop."
    values = {(r.store_id, r.kind, r.value) for r in pg.evidence_values(evidence).collect()}
    assert values == {
        ("s1", "products", "pokemon"), ("s1", "products", "comics"), ("s1", "products", "board_games"), ("s1", "event_types", "events"),
        ("s1", "phones", "555-010-1234"), ("s1", "hours_text", "Mon: 10 am"), ("s1", "json_ld_types", "Store"),
    }
    rows = {r.store_id: r for r in pg.dossiers(evidence).collect()}
    full, bare = rows["s1"], rows["s2"]
    assert (full.pages, full.products, full.event_url) == (2, ["board_games", "comics", "pokemon"], "https://a.example.com/events")
    # 20 for pages, 10 description, 30 products, 20 events, 10 phones, 10 hours; no dated events.
    assert (full.confidence, full.next_step, full.phones, full.hours_text) == (1.0, "review_for_reactivation", 1, 1)
    assert (bare.confidence, bare.next_step, bare.products) == (0.2, "manual_review", [])


def test_streamed_drops_equal_batches(spark, data):
    got = all_queries()["stream_ingest"](spark, data)
    d = Directory(spark, data)
    crawl = qr._crawl(d)
    first = ig.ingest(crawl.filter("source = 'wpn'"), d.stores, d.store_external_refs, d.store_categories, AS_OF)
    second = ig.ingest(crawl.filter("source <> 'wpn'"), first["stores"], first["refs"], first["categories"], AS_OF)
    want = first["outcomes"].unionByName(second["outcomes"]).select(*got.columns)
    assert got.count() == crawl.count()
    # The drops are cut by turn near the change of source; every record is decided the same.
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
