"""Provider pages as a Spark data source: a chain of cursors over a folder of payloads, in batch and as a stream.

The folder is a Parquet table (cursor, next_cursor, payload): the page that a request with
``cursor`` gets (null: the first request), and the cursor for the next. The chain is followed
from ``start`` for ``max_pages`` pages at most, reading cursors only; each page is then a task
of its own. In a stream the offset is the next cursor and the number of pages so far, so a
restarted stream delivers each page once. Nothing here needs a network.

    spark.dataSource.register(PageSource)
    spark.read.format("provider_pages").load(folder)
    spark.readStream.format("provider_pages").option("max_pages", 100).load(folder)
"""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "page int, cursor string, next_cursor string, payload string"


class MissingPage(ValueError):
    """The chain names a cursor that the folder has no page for."""


class Page(InputPartition):
    def __init__(self, number: int, cursor: str | None):
        super().__init__((number, cursor))


class Chain:
    """The pages of a folder, by cursor."""

    def __init__(self, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("provider_pages needs a folder to load")
        self.path, self.start, self.most = options["path"].removeprefix("file:"), options.get("start"), int(options.get("max_pages", "1000"))
        if self.most < 1:
            raise ValueError("max_pages must be 1 or more")

    def look_up(self, cursor: str | None, columns: list[str]) -> dict:
        import pyarrow.dataset as ds

        field = ds.field("cursor")
        found = ds.dataset(self.path, format="parquet", exclude_invalid_files=True).to_table(columns=columns, filter=field.is_null() if cursor is None else field == cursor).to_pylist()
        if len(found) != 1:
            raise MissingPage(f"{len(found)} pages for cursor {cursor!r} in {self.path}")
        return found[0]

    def follow(self, cursor: str | None, done: int) -> list[tuple[int, str | None, str | None]]:
        """(number, cursor, next cursor) of the pages from a cursor on, up to max_pages in all."""
        out, seen = [], set()
        while done < self.most:
            if cursor in seen:
                raise ValueError(f"cursor {cursor!r} comes again")
            seen.add(cursor)
            following = self.look_up(cursor, ["next_cursor"])["next_cursor"]
            out.append((done, cursor, following))
            done, cursor = done + 1, following
            if cursor is None:
                break
        return out

    def rows(self, page: Page):
        number, cursor = page.value
        got = self.look_up(cursor, ["next_cursor", "payload"])
        yield number, cursor, got["next_cursor"], got["payload"]


class PageReader(DataSourceReader):
    def __init__(self, chain: Chain):
        self.chain = chain

    def partitions(self):
        return [Page(n, cursor) for n, cursor, _ in self.chain.follow(self.chain.start, 0)]

    def read(self, partition):
        return self.chain.rows(partition)


class PageStreamReader(DataSourceStreamReader):
    """Offsets: the pages delivered, the cursor of the next one, and whether there is one."""

    def __init__(self, chain: Chain):
        self.chain = chain

    def initialOffset(self) -> dict:
        return {"pages": 0, "cursor": self.chain.start, "more": True}

    def latestOffset(self) -> dict:
        pages = self.chain.follow(self.chain.start, 0)
        number, _, following = pages[-1]
        return {"pages": number + 1, "cursor": following, "more": following is not None}

    def partitions(self, start: dict, end: dict):
        if not start["more"] or start["pages"] >= end["pages"]:
            return []
        return [Page(n, cursor) for n, cursor, _ in self.chain.follow(start["cursor"], start["pages"]) if n < end["pages"]]

    def read(self, partition):
        return self.chain.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "provider_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return PageReader(Chain(dict(self.options)))

    def streamReader(self, schema):
        return PageStreamReader(Chain(dict(self.options)))
