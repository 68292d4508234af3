"""A paged collection as a Spark source: a scan whose page count is fixed by the first page's total, read by ranges of pages.

    spark.dataSource.register(paged_source())
    spark.read.format("paged").option("path", folder).option("pageSize", 100).option("pagesPerTask", 50).load()

A page is the text under number=N in the folder, as a crawl left it. The first page says how many items there are, and that fixes how many pages are asked for, whatever the
later ones say. A page that is not there is a row of status 404, one that cannot be read of 503, so a gap shows and never shortens the scan.
"""

from __future__ import annotations


def paged_source() -> type:
    """The source's class. It is made here, so that it travels to planning and reading workers by value."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Pages(InputPartition):
        def __init__(self, first: int, last: int):
            super().__init__((first, last))
            self.first, self.last = first, last

    def fetched(path: str, number: int) -> tuple[int, str | None]:
        """(status, body) of a page; any file system that Arrow reads."""
        from pyarrow import fs

        try:
            store, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
            found = store.get_file_info(fs.FileSelector(f"{root}/number={number}", allow_not_found=True))
            names = sorted(f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")))
            if not names:
                return 404, None
            return 200, "".join(store.open_input_stream(n).readall().decode("utf-8") for n in names).rstrip("\n")
        except (OSError, ValueError):
            return 503, None

    class Reader(DataSourceReader):
        def __init__(self, options: dict[str, str]):
            self.path, self.size, self.step = options["path"], int(options.get("pagesize", 100)), int(options.get("pagespertask", 50))

        def partitions(self) -> list[InputPartition]:
            """Ranges of pages. Without a readable first page only that is asked for: its row says why."""
            import json

            try:
                total = int(json.loads(fetched(self.path, 1)[1] or "")["response"]["body"]["totalCount"])
            except (ValueError, KeyError, TypeError):
                total = 0
            pages = max(1, -(-total // self.size))
            return [Pages(first, min(pages, first + self.step - 1)) for first in range(1, pages + 1, self.step)]

        def read(self, partition: Pages):
            for number in range(partition.first, partition.last + 1):
                status, body = fetched(self.path, number)
                yield number, self.size, status, body

    class PagedSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return "paged"

        def schema(self) -> str:
            return "number int, asked int, status int, body string"

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    return PagedSource
