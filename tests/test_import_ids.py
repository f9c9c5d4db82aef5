"""The import queries where the ledger already holds the id of their import."""

from collections import Counter

from seatwise.operators import imports
from seatwise.plans import catalog
from tests.conftest import SF001


def test_a_free_id(spark):
    ledger = spark.createDataFrame([(3,), (8,), (None,)], "id long")
    assert [imports.free_id(ledger, n) for n in (3, 5, 8, 9)] == [9, 5, 9, 9]
    assert imports.free_id(ledger.limit(0), 7) == 7


def test_import_files_with_their_id_in_the_ledger(spark, monkeypatch):
    events = spark.read.parquet(f"{SF001}/events.parquet")
    taken = 500  # an event's number, above all imports of the members
    assert events.where(f"event_id = {taken}").count() == 1
    monkeypatch.setattr(catalog, "IMPORT_ID", taken)
    out = catalog._import_files(spark, SF001)
    ids = Counter(r["id"] for r in out["ledger"].select("id").collect())
    assert ids == Counter(r["event_id"] for r in events.collect()) + Counter([taken])
    customers = spark.read.parquet(f"{SF001}/customer.parquet").count()
    members = [r["import_id"] for r in out["members"].select("import_id").collect()]
    assert max(x for x in members if x is not None) == taken
    assert members.count(taken) > customers  # all new members and the updated ones
