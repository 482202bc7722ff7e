"""Small estates with known results."""

import json

LOC = {"file": "x", "line": 1}


def manifest(id, layer, name=None, handlers=(), endpoints=(), calls=(), publishes=(), consumers=(), declared=(), issues=()):
    return {
        "schemaVersion": "1", "generatedAt": "2024-01-01T00:00:00Z", "generator": {"name": "test", "version": "1"}, "service": {"id": id, "name": name or id, "layer": layer},
        "handlers": [{"id": h, "kind": k, "name": h, "location": LOC, "calls": list(c), "hash": f"h-{h}"} for h, k, *c in handlers],
        "endpoints": [{"id": f"{m} {p}", "method": m, "path": p, "handler": h, "location": LOC} for m, p, h in endpoints],
        "consumers": [{"id": i, "broker": b, "topic": t, "handler": h, "location": LOC} for i, b, t, h in consumers],
        "calls": [{"id": i, "method": m, "url": u, "fromHandler": h, "location": LOC} | ({"targetHint": hint} if hint else {}) for i, m, u, hint, h in calls],
        "publishes": [{"id": i, "broker": b, "topic": t, "fromHandler": h, "location": LOC} for i, b, t, h in publishes],
        "declaredDependencies": [{"service": d} for d in declared], "issues": list(issues),
    }


#: A tram network: a kiosk plans rides and tops up cards, cards pay through a bank, receipts follow messages, and the timetable hears of delays.
TRAMS = [
    manifest("kiosk", "ui", "Ticket Kiosk", [("RideScreen.plan", "client"), ("CardScreen.topUp", "client")], calls=[("k1", "GET", "{env.PLANNER}/lines/{line}/stops", "ROUTE_PLANNER", "RideScreen.plan"), ("k2", "POST", "{env.CARDS}/cards/{card}/credit", "CARDS_BASE", "CardScreen.topUp")]),
    manifest("route-planner", "experience", "Ride Planning", [("StopBoard.list", "http", "StopIndex.near"), ("StopIndex.near", "service")], [("GET", "/lines/{line}/stops", "StopBoard.list")], [("r1", "GET", "http://timetable.trams.internal/departures/{stop}", None, "StopIndex.near")]),
    manifest("fare-cards", "capability", None, [("CardDesk.credit", "http", "Purse.add"), ("Purse.add", "service", "Limits.check"), ("Limits.check", "other")], [("POST", "/cards/{card}/credit", "CardDesk.credit")], [("f1", "PUT", "https://giro.bank.example/transfers", None, "Purse.add"), ("f2", "GET", "/zones/{zone}/limit", None, "Limits.check")], [("f3", "kafka", "card.credited", "Purse.add")]),
    manifest("timetable", "domain", None, [("Departures.at", "http"), ("DelayLog.apply", "message")], [("GET", "/departures/{stop}", "Departures.at")], consumers=[("t1", "rabbitmq", "delays", "DelayLog.apply")]),
    manifest("zoning", "domain", None, [("Zones.limit", "http")], [("GET", "/api/zones/{zone}/limit", "Zones.limit")], declared=["timetable", "weather"]),
    manifest("receipts", "processor", None, [("Printer.onCredit", "message")], (), [("p1", "POST", "https://post.letters.example/v1/letters", None, "Printer.onCredit")], (), [("p2", "kafka", "card.credited", "Printer.onCredit")]),
]

TARGETS = {"/^cards?_/": "fare-cards", "giro.bank.example": "external:giro"}


def write(folder, manifests):
    for i, m in enumerate(manifests):
        (folder / f"{i:02d}-{m['service']['id']}.json").write_text(json.dumps(m))
    return str(folder)
