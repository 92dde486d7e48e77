"""The life cycle of reported content: three lanes, screening, merges, release and review, batch by batch.

Events come in order of ``seq``. Community reports wait for a screening; volunteers' reports and detections go straight to
the queue; a copy of known content (same link or same group key, the earliest item first) joins its item. A screening
may restrict a report, merge it with known content, or let it go on; what nobody screens in time goes on with a remark.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.functions import text as T
from triagelake.operators.queue import label_components
from triagelake.operators.similarity import cut
from triagelake.sources.snapshots import KeyedTable
from triagelake.streaming import jobs as J

#: An event: lane is report, volunteer, detection, screening or review; ``target`` is the item of the last two.
EVENT = "seq long, lane string, url string, group_key string, external_id string, target string, priority string, note string, outcome string, t double"
ITEM = "item string, first long, url string, group_key string, source string, status string, priority string, context string, detected_at double, copies long, decision string"
OCCURRENCE = "seq long, item string, url string, source string, external_id string, note string, t double"
RESULT = "seq long, result string, item string"
NOBODY: frozenset[str] = frozenset()
# Fixed values.
RANK = {"none": 0, "standard": 1, "high": 2, "urgent": 3}
DEFAULT, UNSCREENED, RESTRICTED = "Community report without details.", "Not screened in time.", "Restricted by screening."

ROWS = "kind string, root string, seq long, lane string, url string, group_key string, external_id string, target string, priority string, note string, outcome string, t double, " + ITEM.replace("url string, group_key string, ", "").replace("priority string, ", "")
OUT = "kind string, deleted boolean, seq long, external_id string, note string, t double, result string, target string, " + ITEM


OF_EVENT, OF_ITEM = (x.replace(",", "").split()[::2] for x in (EVENT, ITEM))


class Said:
    """What is said of the events of an Arrow batch, by their places in it: occurrences name the item that they came to, with
    their words, whatever becomes of it later."""

    def __init__(self):
        self.at, self.item, self.source, self.note = [], [], [], []
        self.of, self.result, self.what = [], [], []

    def rows(self, batch: pa.RecordBatch, schema: pa.Schema) -> list[pa.RecordBatch]:
        """As a batch of OUT, if there is anything; what the events themselves have is taken from theirs."""
        taken = {c: batch[c].take(pa.array(self.at, pa.int64())) for c in ("seq", "url", "external_id", "t")}
        occurrences = filled(schema, len(self.at), taken | {"kind": "occurrence", "item": self.item, "source": self.source, "note": self.note})
        results = filled(schema, len(self.of), {"kind": "result", "seq": batch["seq"].take(pa.array(self.of, pa.int64())), "result": self.result, "item": self.what})
        return pa.Table.from_batches([occurrences, results]).combine_chunks().to_batches()


def filled(schema: pa.Schema, n: int, columns: dict) -> pa.RecordBatch:
    """A batch of n rows; columns are arrays, lists or one text for all, and null where there is none."""
    made = []
    for field in schema:
        column = columns.get(field.name)
        if column is None:
            column = pa.nulls(n, field.type)
        elif isinstance(column, str):
            column = pa.repeat(pa.scalar(column, field.type), n)
        made.append(column.cast(field.type) if isinstance(column, pa.Array) else pa.array(column, field.type))
    return pa.RecordBatch.from_arrays(made, schema=schema)


class Component:
    """Items that links or group keys may join, and what a batch does to them in order."""

    def __init__(self, timeout: float):
        self.timeout, self.items, self.changed, self.said = timeout, {}, set(), Said()
        self.waiting, self.known, self.into = set(), {}, {}
        self.times: list[tuple[float, str]] = []  # a heap of what has waited; names that no longer wait are passed over
        self.by: dict[tuple[str, str], set[str]] = {}

    def add(self, item: dict) -> dict:
        self.items[item["item"]] = item
        self.index(item)
        if item["status"] == "SCREENING":
            self.waiting.add(item["item"])
            heapq.heappush(self.times, (item["detected_at"], item["item"]))
        return item

    def index(self, item: dict) -> None:
        for column in ("url", "group_key"):
            if item[column] is not None:
                self.by.setdefault((column, item[column]), set()).add(item["item"])

    def create(self, e: dict, name: str, source: str, priority: str, context: str | None, status: str = "PENDING", group_key: str | None = None) -> dict:
        self.changed.add(name)
        return self.add({"item": name, "first": e["seq"], "url": e["url"], "group_key": group_key, "source": source, "status": status, "priority": priority, "context": context, "detected_at": e["t"], "copies": 0, "decision": None})

    def earliest(self, url: str | None, group_key: str | None = None, other_than: str | None = None) -> dict | None:
        names = self.by.get(("url", url), NOBODY) if url is not None else NOBODY
        if group_key is not None:
            names = names | self.by.get(("group_key", group_key), NOBODY)
        if len(names) == 1 and other_than is None:
            (name,) = names
            return self.items[name]
        found = [self.items[n] for n in names if n != other_than]
        return min(found, key=lambda i: (i["detected_at"], i["first"]), default=None)

    def change(self, item: dict, **values) -> None:
        item.update(values)
        self.changed.add(item["item"])
        if item["status"] != "SCREENING":
            self.waiting.discard(item["item"])
        if values.get("group_key") is not None:
            self.index(item)

    def join(self, item: dict, e: dict, source: str, priority: str | None = None, note: str | None = None) -> None:
        """One more copy; it raises the item's priority, and a restricted item takes no words."""
        urgent = priority if priority and RANK[priority] > RANK.get(item["priority"], 0) else item["priority"]
        self.change(item, copies=item["copies"] + 1, priority=urgent)
        self.occurred(e["at"], item, source, note)

    def occurred(self, at: int, item: dict, source: str, note: str | None) -> None:
        self.said.at.append(at)
        self.said.item.append(item["item"])
        self.said.source.append(source)
        self.said.note.append(note)

    def release(self, now: float) -> None:
        while self.times and self.times[0][0] < now - self.timeout:
            name = heapq.heappop(self.times)[1]
            if name in self.waiting:
                self.change(self.items[name], status="PENDING", context=f"{self.items[name]['context']}\n{UNSCREENED}")

    def events(self, rows: dict[str, list], start: int, end: int) -> None:
        """Events in order, from ``rows`` by column, of whose batch ``said`` tells. Most events copy what is known and has left
        screening, or name what does not exist; those are short. All others are the lane's own."""
        items, said, times = self.items, self.said, self.times
        for k in range(start, end):
            lane, t = rows["lane"][k], rows["t"][k]
            if times and times[0][0] < t - self.timeout:
                self.release(t)
            if lane in ("screening", "review"):
                name = rows["target"][k]
                item = items.get(name)
                result = "missing" if item is None else "refused" if lane == "screening" and item["status"] != "SCREENING" else None
            else:
                item = self.known_copy(lane, rows, k)
                result = None
                if item is not None:
                    item["copies"] += 1
                    name, result = item["item"], "joined"
                    self.changed.add(name)
            if result is None:
                result, name = getattr(self, lane)({"at": k} | {c: rows[c][k] for c in OF_EVENT})
            said.of.append(k)
            said.result.append(result)
            said.what.append(name)

    def known_copy(self, lane: str, rows: dict[str, list], k: int) -> dict | None:
        """The item that an event only copies, with its words; none where more than copies and priority may change."""
        if lane == "detection":
            if rows["external_id"][k] in self.known:
                return None
            item = self.earliest(rows["url"][k], rows["group_key"][k])
            if item is None or item["status"] == "SCREENING" or item["group_key"] is None and rows["group_key"][k] is not None:
                return None
            self.known[rows["external_id"][k]] = item["item"]
            source, note = "DETECTION", None
        else:
            item = self.earliest(rows["url"][k])
            if item is None or lane == "volunteer" and item["status"] == "SCREENING":
                return None
            source, note = ("VOLUNTEER", rows["note"][k]) if lane == "volunteer" else ("PUBLIC", (rows["note"][k] or "").strip() or None)
        priority = rows["priority"][k] if lane != "report" else None
        if priority and RANK[priority] > RANK.get(item["priority"], 0):
            item["priority"] = priority
        self.occurred(k, item, source, note)
        return item

    def report(self, e: dict):
        note, item = (e["note"] or "").strip() or None, self.earliest(e["url"])
        result = "joined" if item else "created"
        item = item or self.create(e, f"public-{e['seq']}", "PUBLIC", "standard", note or DEFAULT, "SCREENING")
        self.join(item, e, "PUBLIC", note=note)
        return result, item["item"]

    def volunteer(self, e: dict):
        item = self.earliest(e["url"])
        result = "joined" if item else "created"
        if item is None:
            item = self.create(e, f"vol-{e['seq']}", "VOLUNTEER", e["priority"] or "standard", e["note"])
        elif item["status"] == "SCREENING":  # somebody trained vouches for it
            self.change(item, status="PENDING")
        self.join(item, e, "VOLUNTEER", e["priority"], e["note"])
        return result, item["item"]

    def detection(self, e: dict):
        if e["external_id"] in self.known:
            name = self.known[e["external_id"]]
            return "known", self.final(name)
        item = self.earliest(e["url"], e["group_key"])
        result = "joined" if item else "created"
        if item is None:
            item = self.create(e, f"hw-{e['external_id']}", "DETECTION", e["priority"] or "standard", e["note"], group_key=e["group_key"])
        else:
            if item["group_key"] is None and e["group_key"] is not None:
                self.change(item, group_key=e["group_key"])
            if item["status"] == "SCREENING":  # the model has seen this content now
                self.change(item, status="PENDING", context=f"{item['context']}\nModel: {e['note']}")
        self.known[e["external_id"]] = item["item"]
        self.join(item, e, "DETECTION", e["priority"])
        return result, item["item"]

    def screening(self, e: dict):
        item = self.items.get(e["target"])
        if item is None:
            return "missing", e["target"]
        if item["status"] != "SCREENING":
            return "refused", item["item"]
        if e["outcome"] == "restricted":
            self.change(item, status="RESTRICTED", context=RESTRICTED)
            return "restricted", item["item"]
        if e["group_key"] is not None:
            other = self.earliest(None, e["group_key"], other_than=item["item"])
            if other is not None:
                self.merge(item, other)
                return "merged", other["item"]
            self.change(item, group_key=e["group_key"])
        words = {"flagged": f"Screening: {e['note'] or 'flagged'}", "not_flagged": f"Screening: not flagged. {e['note'] or ''}".rstrip()}.get(e["outcome"], "Not screened: not available.")
        priority = {"flagged": e["priority"] or item["priority"], "not_flagged": "none"}.get(e["outcome"], item["priority"])
        self.change(item, status="PENDING", priority=priority, context=f"{item['context']}\n{words}")
        return "screened", item["item"]

    def review(self, e: dict):
        item = self.items.get(e["target"])
        if item is None or item["status"] in ("SCREENING", "RESTRICTED"):
            return "missing", e["target"]
        self.change(item, status="REVIEWED", decision=e["outcome"])
        return "reviewed", item["item"]

    def merge(self, item: dict, other: dict) -> None:
        """All copies of an item go to another one; the item is no more."""
        self.change(other, copies=other["copies"] + item["copies"])
        name = item["item"]
        del self.items[name]
        self.waiting.discard(name)
        self.changed.add(name)
        for column in ("url", "group_key"):
            self.by.get((column, item[column]), set()).discard(name)
        self.into[name] = other["item"]

    def final(self, name: str) -> str:
        """The item that an item has come to by merges."""
        passed = []
        while name in self.into:
            passed.append(name)
            name = self.into[name]
        for one in passed:
            self.into[one] = name
        return name

    def rows(self, now: float):
        """What a batch leaves besides, as rows of OUT."""
        self.release(now)
        for name in sorted(self.changed):
            yield {"kind": "item", "item": name, "deleted": True} if name not in self.items else {"kind": "item", "deleted": False} | self.items[name]
        yield from ({"kind": "move", "item": a, "target": self.final(a)} for a in [*self.into])


def listed(column: pa.Array) -> list:
    """The values, None for null, in far less time than one by one."""
    if pa.types.is_string(column.type) or not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def folded(timeout: float, now: float, schema: pa.Schema, most: int = 5_000):
    """Arrow function over rows sorted by root, stored things first: each component as it streams by. Of a component only
    its items are kept; what is said of its events goes out with their batch, what it leaves with about ``most`` rows at a
    time. Rows pass by columns, since a row for itself would take most of the time."""

    def run(batches):
        of, last, out = None, None, []
        for batch in batches:
            said, kinds = Said(), listed(batch["kind"])
            rows = {c: listed(batch[c]) for c in dict.fromkeys([*OF_EVENT, "item"])}
            root = batch["root"].dictionary_encode()
            names, codes = root.dictionary.to_pylist(), root.indices.to_numpy()
            starts = np.flatnonzero(np.diff(codes, prepend=-1)).tolist()
            for start, end in zip(starts, [*starts[1:], len(kinds)]):
                if names[codes[start]] != last:
                    out += of.rows(now) if of else []
                    of, last = Component(timeout), names[codes[start]]
                of.said = said
                stored = next((k for k in range(start, end) if kinds[k] == "2 event"), end)
                for k in range(start, stored):
                    if kinds[k] == "0 item":
                        of.add({c: batch[c][k].as_py() for c in OF_ITEM})
                    else:
                        of.known[rows["external_id"][k]] = rows["item"][k]
                of.events(rows, stored, end)
            yield from said.rows(batch, schema)
            if len(out) >= most:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        out += of.rows(now) if of else []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


class LifeCycle:
    """Items and their occurrences in keyed tables under a folder; ``apply`` takes one batch of events and may be repeated."""

    def __init__(self, spark, at: str, timeout: float = J.TIMEOUT_S):
        self.spark, self.at, self.timeout = spark, at, timeout
        self.items = KeyedTable(spark, f"{at}/items", ["item"], ITEM)
        self.occurrences = KeyedTable(spark, f"{at}/occurrences", ["seq"], OCCURRENCE)

    def touched(self, events: DataFrame, items: DataFrame, known: DataFrame, now: float) -> DataFrame:
        """Stored items that a batch may change: by link, group key or name, or because their time is over."""
        names = [events.select(F.col("target").alias("item")), known.select("item")]
        by = [items.join(events.select(c).where(F.col(c).isNotNull()).distinct(), c, "left_semi").select("item") for c in ("url", "group_key")]
        stale = items.where((F.col("status") == "SCREENING") & (F.col("detected_at") < now - self.timeout)).select("item")
        every = stale
        for part in (*names, *by):
            every = every.union(part)
        return items.join(every.distinct(), "item", "left_semi")

    def apply(self, batch: DataFrame, number: int) -> None:
        # links are normalised after the shuffle, in more tasks than a batch has files
        events = cut(batch.dropDuplicates(["seq"]).withColumn("url", F.when(F.col("url").isNotNull(), T.normalize_url(F.col("url")))))
        now = events.agg(F.max("t")).first()[0]
        if now is None:
            return
        known = self.occurrences.rows(number).join(events.select("external_id").where("external_id IS NOT NULL").distinct(), "external_id", "left_semi").select("external_id", "item")
        items = cut(self.touched(events, self.items.rows(number), known, now))
        node = lambda letter, column: F.concat(F.lit(letter), F.col(column))
        made = F.when(F.col("lane") == "report", F.concat(F.lit("i:public-"), F.col("seq"))).when(F.col("lane") == "volunteer", F.concat(F.lit("i:vol-"), F.col("seq"))).when(F.col("lane") == "detection", node("i:hw-", "external_id"))
        named = F.col("lane").isin("screening", "review")
        at_home = F.coalesce(F.when(named, node("i:", "target")), node("u:", "url"), node("x:", "external_id"), F.concat(F.lit("e:"), F.col("seq")))
        # what names an item that this batch may make stands where that is made, so that the search has no node an event
        places = events.where(made.isNotNull()).groupBy(made.alias("name")).agg(F.min(at_home).alias("place"))
        at = events.join(places, named & (node("i:", "target") == F.col("name")), "left").withColumn("node", F.coalesce("place", at_home))
        events = cut(at.drop("name", "place"))
        ends = F.array_compact(F.array("node", node("g:", "group_key"), node("x:", "external_id")))
        link = lambda rows, own, others: rows.withColumn("node", own).select(F.col("node").alias("a"), F.explode(others).alias("b")).distinct()
        edges = link(events, F.col("node"), ends).union(link(items, node("i:", "item"), F.array_compact(F.array("node", node("u:", "url"), node("g:", "group_key")))))
        edges = edges.union(link(known, node("x:", "external_id"), F.array(node("i:", "item"))))
        roots = label_components(edges)
        parts = [items.select("*", F.lit("0 item").alias("kind"), node("i:", "item").alias("node"), F.col("first").alias("seq"))]
        parts.append(known.select("*", F.lit("1 known").alias("kind"), node("x:", "external_id").alias("node")))
        parts.append(events.select("*", F.lit("2 event").alias("kind")))
        rows = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
        rows = rows.join(roots, "node").drop("node").repartition("root").sortWithinPartitions("root", "kind", "seq")
        empty = self.spark.createDataFrame([], OUT)
        out = cut(rows.mapInArrow(folded(self.timeout, now, empty.toArrow().schema), OUT))
        changed = out.where("kind = 'item'")
        self.items.upsert(changed.select(*self.items.schema.names, "deleted"), number)
        # occurrences follow their item, and lose their words with it
        moves = out.where("kind = 'move'").select("item", "target")
        gone = changed.where("status = 'RESTRICTED'").select(F.col("item").alias("final"), F.lit(True).alias("silent"))
        final = F.coalesce("target", "item")
        followed = lambda rows: rows.join(moves, "item", "left").withColumn("final", final).join(gone, "final", "left")
        every = followed(self.occurrences.rows(number)).where("target IS NOT NULL OR silent").unionByName(followed(out.where("kind = 'occurrence'").select(self.occurrences.schema.names)))
        every = every.withColumn("note", F.when(F.col("silent").isNull(), F.col("note"))).withColumn("item", F.col("final"))
        self.occurrences.upsert(every.select(self.occurrences.schema.names), number)
        J.write_batch(out.where("kind = 'result'").select("seq", "result", "item"), number, f"{self.at}/results")

    def run(self, events: DataFrame) -> LifeCycle:
        """Takes what a stream of events has; started again in the same folder, it goes on."""
        query = events.writeStream.option("checkpointLocation", f"{self.at}/state").trigger(availableNow=True).foreachBatch(self.apply).start()
        query.awaitTermination()
        return self

    def results(self) -> DataFrame:
        return J.read_batches(self.spark, f"{self.at}/results", f"{RESULT}, batch long").drop("batch")
