"""Mailbox change feeds as streams whose offsets are the providers' own cursors (S4, ST3, ST4).

A feed is a folder of stored answers, one folder for each account (``account_id=7``), of JSON lines,
one for each page: ``since`` (the cursor that was asked with), ``cursor`` (the one to ask with next)
and the page's content. The stream keeps a cursor for each account in its checkpoint and goes on
from there; a cursor that the feed no longer knows is answered by one row ``not_found`` and the
newest cursor. Any file system that pyarrow reaches will do.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Rows of both providers; ``cursor`` is what the account stood at before, null at its first time.
PAGE = (
    "account_id long, cursor string, page_no long, not_found boolean, added array<string>, touched array<string>, history_id string, "
    "messages array<struct<id:string,removed:boolean,has_attachments:boolean>>, delta_link string"
)


def _files(path: str):
    """The file system and the accounts' folders with their files, oldest first."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    found: dict[str, list[str]] = {}
    for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        folder, _, name = info.path.rpartition("/")
        if info.is_file and name.endswith((".json", ".jsonl")) and "/account_id=" in f"/{folder}":
            found.setdefault(folder.rpartition("account_id=")[2], []).append(info.path)
    return store, {account: sorted(files) for account, files in found.items()}


def _pages(store, files: list[str]) -> Iterator[dict]:
    for file in files:
        with store.open_input_stream(file) as stream:
            for line in stream.read().decode().splitlines():
                if line.strip():
                    yield json.loads(line)


def _newest(store, files: list[str]) -> str | None:
    """The cursor that the last stored page gives; earlier files are not read."""
    for file in reversed(files):
        last = None
        for page in _pages(store, [file]):
            last = last if page.get("cursor") is None else page["cursor"]
        if last is not None:
            return str(last)
    return None


class AccountPages(InputPartition):
    """The pages of one account from one cursor to another."""

    def __init__(self, account: str, start: str | None, end: str | None):
        self.account, self.start, self.end = account, start, end


class FeedReader(DataSourceStreamReader):
    """Offsets are {account: cursor}. An account is one partition of a micro-batch."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, accounts = _files(self.path)
        return {account: cursor for account, files in sorted(accounts.items()) if (cursor := _newest(store, files)) is not None}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [AccountPages(account, start.get(account), cursor) for account, cursor in end.items() if start.get(account) != cursor]

    def read(self, partition: AccountPages) -> Iterator[tuple]:
        store, accounts = _files(f"{self.path}/account_id={partition.account}")
        files = accounts.get(partition.account) or [f for some in accounts.values() for f in some]
        account, at, n = int(partition.account), partition.start, 0
        if at is not None:
            met = False
            for page in _pages(store, files):
                if met or str(page.get("since")) == at:  # pages of one answer go on from each other
                    met, n = True, n + 1
                    messages = [(m.get("id"), m.get("removed"), m.get("has_attachments")) for m in page.get("messages") or ()]
                    yield account, at, n, False, page.get("added"), page.get("touched"), _text(page.get("cursor")), messages, page.get("delta_link")
                    if str(page.get("cursor")) == partition.end:
                        return
            if met:
                return
        yield account, at, n + 1, at is not None, None, None, partition.end, [], None

    def commit(self, end: dict) -> None:
        pass


def _text(value) -> str | None:
    return None if value is None else str(value)


class MailFeed(DataSource):
    """``spark.readStream.format("mail_feed").load(path)``: pages after each account's cursor."""

    @classmethod
    def name(cls) -> str:
        return "mail_feed"

    def schema(self) -> str:
        return PAGE

    def streamReader(self, schema) -> FeedReader:
        return FeedReader(self.options["path"].rstrip("/"))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """The feed's pages as a stream; an account without a cursor has one row that tells the newest."""
    spark.dataSource.register(MailFeed)
    return spark.readStream.format("mail_feed").load(path)


def known_cursors(pages: DataFrame) -> DataFrame:
    """account_id and cursor before a micro-batch of pages, as :func:`events.history_to_messages` takes them."""
    return pages.groupBy("account_id").agg(F.max("cursor").alias("cursor"))
