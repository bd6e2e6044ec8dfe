"""Python data sources for SQLite message stores and mbox mail archives.

``spark.read.format("sqlite_messages")`` and ``("mbox")``; each file is one partition. Files must be
readable on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAIL = "pos long, message_id string, in_reply_to string, sender string, date string, body string"
#: Query of the message store, by column name of the result.
MESSAGES_SQL = (
    "select m.timestamp, m.chat_id, coalesce(c.name, case when m.is_outgoing then 'me' else 'unknown' end) as sender, "
    "m.is_outgoing as is_me, m.body as text from messages m left join contacts c on c.id = m.sender_id order by m.timestamp"
)


class _Files(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        return [InputPartition(p) for p in self.options["path"].split(",")]


class _SqliteReader(_Files):
    def read(self, partition) -> Iterator[tuple]:
        import sqlite3
        from datetime import datetime, timezone

        with sqlite3.connect(f"file:{partition.value}?mode=ro", uri=True) as db:
            for stamp, chat, sender, me, text in db.execute(self.options.get("query", MESSAGES_SQL)):
                if text and str(text).strip():
                    if isinstance(stamp, int | float):
                        seconds = stamp / 1000 if stamp > 1e12 else stamp
                        stamp = datetime.fromtimestamp(seconds, timezone.utc).isoformat()
                    yield str(stamp), str(chat), sender, bool(me), str(text).strip()


class SqliteMessages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_messages"

    def schema(self) -> str:
        return "timestamp string, chat_id string, sender string, is_me boolean, text string"

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self.options)


class _MboxReader(_Files):
    def read(self, partition) -> Iterator[tuple]:
        import mailbox

        for pos, message in enumerate(mailbox.mbox(partition.value)):
            yield pos, message["Message-ID"], message["In-Reply-To"], message["From"], message["Date"], plain_body(message)


def plain_body(message) -> str:
    """The first text/plain part in its charset; undecodable bytes are replaced."""
    for part in message.walk() if message.is_multipart() else [message]:
        if part.get_content_type() == "text/plain" and (data := part.get_payload(decode=True)) is not None:
            try:
                return data.decode(part.get_content_charset() or "utf-8", "replace")
            except LookupError:
                return data.decode("utf-8", "replace")
    return ""


class Mbox(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mbox"

    def schema(self) -> str:
        return MAIL

    def reader(self, schema) -> DataSourceReader:
        return _MboxReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (SqliteMessages, Mbox):
        spark.dataSource.register(source)
