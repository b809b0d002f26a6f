"""Order headers from events that lack fields, carry texts for numbers, or come again."""

import json

from comanda.sources import payloads


def event(stream, order, **more):
    return (json.dumps({"stream_id": stream, "event_id": f"e{stream}", "occurred_at": "2024-05-01T10:00:00", "raw_event": {"raw_payload": {"properties": {"Order": {"orderID": order, **more}}}}}),)


def test_headers(spark):
    rows = [
        event(1, 7, total=10.5, order_type="Delivery", round_off="-0.25", delivery_charges=30, no_of_persons="2", core_total="x", created_on="2024-05-01 09:00:00"), event(9, 7, total=99, order_type="Pick Up", biller="late"),
        event(2, 8, no_of_persons=None, comment=5), event(3, None), ("broken",), (None,),
    ]
    got = {r.order_id: r for r in payloads.headers(spark.createDataFrame(rows, "payload string")).collect()}
    assert sorted(got) == [7, 8]
    a, b = got[7], got[8]
    assert (a.stream_id, a.event_id, a.total, a.order_type, a.round_off, a.delivery_charges, a.no_of_persons, a.core_total, a.biller, str(a.created_on)) == (9, "e9", 10.5, "Delivery", -0.25, 30.0, 2, 0.0, None, "2024-05-01 09:00:00")
    assert (b.stream_id, b.total, b.order_type, b.order_status, b.no_of_persons, b.comment, str(b.created_on)) == (2, 0.0, "", "", 0, "5", "2024-05-01 10:00:00")
    assert payloads.headers(spark.createDataFrame([], "payload string")).count() == 0
