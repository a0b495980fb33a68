import re
from datetime import datetime

import pytest

from stacklight.sources import harvest

URL, DRIVER = "jdbc:derby:memory:library", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
TABLES = {
    "biblio": "biblionumber INT, title VARCHAR(99), subtitle VARCHAR(99), author VARCHAR(99), abstract VARCHAR(99), notes VARCHAR(99), copyrightdate INT, opac_suppressed INT, \"TIMESTAMP\" TIMESTAMP",
    "biblioitems": "biblioitemnumber INT, biblionumber INT, isbn VARCHAR(99), publishercode VARCHAR(99), publicationyear VARCHAR(9)",
    "items": "itemnumber INT, biblionumber INT, barcode VARCHAR(9), homebranch VARCHAR(9), holdingbranch VARCHAR(9), itemcallnumber VARCHAR(9), itype VARCHAR(9), onloan VARCHAR(19), location VARCHAR(9), issues INT",
    "issues": "issue_id INT, borrowernumber INT, itemnumber INT, issuedate TIMESTAMP, returndate TIMESTAMP, renewals_count INT",
    "old_issues": "issue_id INT, borrowernumber INT, itemnumber INT, issuedate TIMESTAMP, returndate TIMESTAMP, renewals_count INT",
    "ratings": "borrowernumber INT, biblionumber INT, rating_value INT, \"TIMESTAMP\" TIMESTAMP",
}


@pytest.fixture(scope="module")
def url(spark):
    """The library's tables in an in-memory database."""
    con = spark._jvm.java.sql.DriverManager.getConnection(f"{URL};create=true")
    do = con.createStatement()
    for name, columns in TABLES.items():
        do.execute(f"CREATE TABLE {name} ({columns})")
    for i in range(100):
        do.execute(f"INSERT INTO biblio VALUES ({i + 1}, 'T{i}', NULL, 'A', NULL, '', 1990, {int(i == 7)}, TIMESTAMP('2024-01-{1 + i % 28:02d} 12:00:00'))")
        do.execute(f"INSERT INTO items VALUES ({i + 1}, {i + 1}, 'b{i}', 'X', 'X', NULL, NULL, NULL, NULL, NULL)")
        do.execute(f"INSERT INTO {'issues' if i % 3 else 'old_issues'} VALUES ({i + 1}, {i % 5}, {i + 1}, TIMESTAMP('2024-01-01 00:00:00'), {'NULL' if i % 3 else chr(39) + '2024-02-01 00:00:00' + chr(39)}, NULL)")
    do.execute("INSERT INTO biblioitems VALUES (1, 1, '978-0-306-40615-7', 'P', '2001')")
    do.execute("INSERT INTO ratings VALUES (1, 1, 5, TIMESTAMP('2024-01-01 00:00:00')), (2, 1, 9, TIMESTAMP('2024-01-01 00:00:00'))")
    yield URL
    con.close()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranges_of_the_key(spark, url):
    rows = harvest.jdbc(spark, url, "items", "itemnumber", partitions=4, driver=DRIVER)
    assert rows.rdd.getNumPartitions() == 4 and rows.count() == 100
    assert sorted(rows.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()) == [25, 25, 25, 25]
    assert harvest.jdbc(spark, url, "items", driver=DRIVER).rdd.getNumPartitions() == 1
    # one value or none needs no ranges
    assert harvest.jdbc(spark, url, "biblioitems", "biblioitemnumber", driver=DRIVER).count() == 1
    assert harvest.jdbc(spark, url, "(SELECT * FROM items WHERE itemnumber < 0) nobody", "itemnumber", driver=DRIVER).count() == 0


def test_what_the_database_sifts(spark, url):
    since = datetime(2024, 1, 20, 12)
    rows = harvest.database(spark, url, since, 3, driver=DRIVER)["biblio"]
    assert rows.rdd.getNumPartitions() == 3
    narrow = rows.where("opac_suppressed = 0").select("biblionumber", "title")
    assert re.search(r"PushedFilters: \[.*\*GreaterThan\(TIMESTAMP,2024-01-20", plan(narrow))
    assert re.search(r"ReadSchema: struct<([^>]*)>", plan(narrow))[1].count(":") == 2
    assert narrow.count() == sum(i % 28 + 1 > 20 and i != 7 for i in range(100))


def test_the_database_path(spark, url):
    t = harvest.database(spark, url, driver=DRIVER)
    works = harvest.database_works(t["biblio"], t["biblioitems"])
    one = works.where("source_record_id = '1'").first()
    assert works.count() == 99 and (one.title, one.isbns, one.publication_year) == ("T0", ["9780306406157"], 2001)
    assert harvest.database_works(t["biblio"], t["biblioitems"], datetime(2024, 1, 27, 12)).count() == sum(i % 28 == 27 for i in range(100))
    assert harvest.database_items(t["items"], t["biblio"]).count() == 99
    loans = harvest.database_loans(t["issues"], t["old_issues"], t["items"], t["biblio"], "s").collect()
    assert len(loans) == 99 and sum(r.checked_in_at is not None for r in loans) == 34 and all(len(r.patron_ref) == 32 for r in loans)
    assert [r.rating for r in harvest.database_ratings(t["ratings"], "s").collect()] == [5]
