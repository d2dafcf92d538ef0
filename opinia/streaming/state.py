"""The greedy rule as state per run: pages are decided in their order, whatever order they arrive in.

The state of a run lies in the state store (RocksDB): one row with the next page to decide,
how many reviews were kept, the first total that a page announced, the pages that wait for an
earlier one and the first `LISTED_KEYS` keys kept so far; the waiting pages themselves and the
keys of longer runs are looked up one by one.  A micro-batch reads and writes only that row
and the pages and keys that are its own, so its cost does not grow with the stream.  Every
call to the store waits for an answer: a run takes one to read and one to write.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FIRST_PAGE = 1
LISTED_KEYS = 4096
#: A page as it goes through the state: facts and reviews are JSON.
PAGE_STATE = "run string, page int, facts string, reviews string, kept_so_far long, header_total long"
#: What is known of a run; `listed` holds its first keys.
RUN_STATE = "page int, kept long, header long, held int, lowest int, listed string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class GreedyRule(StatefulProcessor):
    """Pages of one run, each with the reviews that the rule keeps.

    A page that was decided before is left out; of several captures of a page in one
    micro-batch the one that finished last counts.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", RUN_STATE)
        self.seen = handle.getMapState("seen", "key string", "page int")
        self.waiting = handle.getMapState("waiting", "page int", "facts string, reviews string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # `held` pages wait, none of them below `lowest`.
        first, kept_so_far, header, held, lowest, listed = self.run.get() or (FIRST_PAGE, 0, None, 0, 0, "")
        arrived: dict[int, tuple] = {}
        for row in rows:
            if row.page >= first and (row.page not in arrived or row.captured > arrived[row.page][0]):
                arrived[row.page] = (row.captured, row.facts, row.reviews)
        at, listed = first, _Listed(listed)
        keys = _Keys(listed, self.seen, first > FIRST_PAGE)
        while True:
            earlier = self.waiting.getValue((at,)) if held and at >= lowest else None
            if earlier is not None:
                self.waiting.removeKey((at,))
                held -= 1
            if at in arrived:
                _, facts, reviews = arrived.pop(at)
            elif earlier is not None:
                facts, reviews = earlier
            else:
                break
            kept = _kept(at, reviews, keys)
            kept_so_far += len(kept)
            header = json.loads(facts).get("header") if header is None else header
            yield Row(run=key[0], page=at, facts=facts, reviews=json.dumps(kept, ensure_ascii=False),
                      kept_so_far=kept_so_far, header_total=header)
            at += 1
        for page, (_, facts, reviews) in arrived.items():
            if not (held and page >= lowest and self.waiting.containsKey((page,))):
                lowest = min(page, lowest) if held else page
                held += 1
            self.waiting.updateValue((page,), (facts, reviews))
        if at > first or arrived:
            keys.store()
            self.run.update((at, kept_so_far, header, held, lowest, listed.text()))

    def close(self) -> None:
        pass


class _Listed:
    """The listed keys, as one text in the state of the run; keys hold no line feed."""

    def __init__(self, text: str):
        self.keys = text.split("\n") if text else []

    def get(self) -> Iterator[tuple[str]]:
        return ((key,) for key in self.keys)

    def appendList(self, keys: list[tuple[str]]) -> None:
        self.keys += [key for key, in keys]

    def text(self) -> str:
        return "\n".join(self.keys)


class _Keys:
    """The keys of a run's kept reviews: those listed, loaded when first asked for, the others in the map."""

    def __init__(self, listed, seen, begun: bool):
        self.listed, self.seen, self.begun = listed, seen, begun
        self.known: dict[str, bool] | None = None
        self.new: dict[str, int] = {}

    def holds(self, key: str) -> bool:
        if self.known is None:
            # Nothing is kept of a run of which no page was decided.
            self.known = {k: True for k, in self.listed.get()} if self.begun else {}
            # A run begun without a list has its keys in the map.
            self.room = 0 if self.begun and not self.known else LISTED_KEYS - len(self.known)
            self.mapped = self.begun and self.room <= 0
        if key not in self.known:
            self.known[key] = self.mapped and self.seen.containsKey((key,))
        return self.known[key]

    def add(self, key: str, page: int) -> None:
        self.known[key], self.new[key] = True, page

    def store(self) -> None:
        rows = list(self.new.items())
        room = self.room if rows else 0
        if rows[:room]:
            self.listed.appendList([(key,) for key, _ in rows[:room]])
        for key, page in rows[room:]:
            self.seen.updateValue((key,), (page,))


def _kept(page: int, reviews: str, known: _Keys) -> list[dict]:
    kept = []
    for row in json.loads(reviews):
        keys = ["c" + row["pair"]] + (["i" + row["review_id"]] if row.get("review_id") else [])
        if not any([known.holds(k) for k in keys]):
            kept.append(row)
            for k in keys:
                known.add(k, page)
    return kept


def decided(pages: DataFrame) -> DataFrame:
    """Pages (run, page, captured, facts, reviews) in the order of their run, with the kept reviews."""
    return pages.groupBy("run").transformWithState(GreedyRule(), PAGE_STATE, "Append", "None")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session's setting comes back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
