"""Exported conversations in JSON files and ZIP archives, as a data source: a partition for each archive member, read as a stream.

An archive's table of contents is read once, to plan; each task then opens only its member and takes the member's array apart
conversation by conversation, so neither an archive nor an export is ever held whole. Any file system that Arrow knows can be read.

    spark.dataSource.register(ConversationExport)
    spark.read.format("conversation_export").load("folder, file or address")

Defined cases: a file that is no ZIP, or a member that is no JSON: one row with its error, after what could be read; a member that holds one
object: one conversation; other members and folders: passed over; a conversation without messages or of another kind: no turns.
"""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator
from io import TextIOWrapper

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, member string, place long, turns array<struct<role:string,text:string>>, error string"
PIECE = 1 << 20


def message_text(content) -> str:
    """The text of a message's content: a string, or the strings among its parts."""
    if isinstance(content, dict):
        content = content.get("parts", [])
    if isinstance(content, list):
        return "\n".join(x for x in content if isinstance(x, str))
    return content if isinstance(content, str) else ""


def turns(conversation) -> list[dict]:
    """(role, text) of a conversation: its messages as listed, or else those of its nodes with a known role and a text, by time."""
    if not isinstance(conversation, dict):
        return []
    listed = conversation.get("messages")
    if isinstance(listed, list) and listed:
        return [{"role": m.get("role"), "text": message_text(m.get("content", ""))} for m in listed if isinstance(m, dict)]
    found = []
    nodes = conversation.get("mapping")
    for node in nodes.values() if isinstance(nodes, dict) else ():
        message = (node or {}).get("message") if isinstance(node, dict) else None
        if not isinstance(message, dict):
            continue
        role, text, at = (message.get("author") or {}).get("role"), message_text(message.get("content", "")), message.get("create_time") or 0
        if role in ("user", "assistant") and text:
            found.append((at, {"role": role, "text": text}))
    return [m for _, m in sorted(found, key=lambda x: x[0])]


def elements(stream, piece: int = PIECE) -> Iterator[object]:
    """The elements of a JSON array in a text stream, one at a time; the value itself if it is no array.

    What is held is one element and a piece of the stream; an element longer than that is tried again with twice as much.
    """
    decoder, held, at, inside = json.JSONDecoder(), stream.read(piece), 0, False
    held = held.lstrip("﻿")

    def more() -> bool:
        nonlocal held, at
        new = stream.read(max(piece, len(held) - at))
        held, at = held[at:] + new, 0
        return bool(new)

    while True:
        while at < len(held) and (held[at].isspace() or inside and held[at] == ","):
            at += 1
        if at == len(held):
            if not more():
                if inside:
                    raise ValueError("the array doesn't end")
                return
            continue
        if not inside and held[at] == "[":
            inside, at = True, at + 1
            continue
        if inside and held[at] == "]":
            return
        try:
            value, end = decoder.raw_decode(held, at)
        except ValueError:
            if not more():
                raise
            continue
        # A number may go on in the next piece.
        if end == len(held) and more():
            continue
        yield value
        at = end
        if not inside:
            return


class _Member(InputPartition):
    def __init__(self, path: str, member: str | None, error: str | None = None):
        self.path, self.member, self.error = path, member, error


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = self._open()
        info = system.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        found: list[InputPartition] = []
        for path in sorted(f.path for f in files if f.type == fs.FileType.File):
            if path.lower().endswith(".json"):
                found.append(_Member(path, None))
            elif path.lower().endswith(".zip"):
                try:
                    with system.open_input_file(path) as file, zipfile.ZipFile(file) as archive:
                        found += [_Member(path, i.filename) for i in archive.infolist() if not i.is_dir() and i.filename.lower().endswith(".json")]
                except (zipfile.BadZipFile, ValueError) as e:  # Arrow's files don't seek before their beginning
                    found.append(_Member(path, None, f"not a ZIP archive: {e}"))
        return found or [_Member("", None, "")]

    def read(self, part: _Member) -> Iterator[tuple]:
        if part.error is not None:
            if part.path:
                yield part.path, None, None, None, part.error
            return
        system, _ = self._open()
        place = 0
        try:
            with system.open_input_file(part.path) as file:
                if part.member is None:
                    found = elements(TextIOWrapper(file, "utf-8"))
                    for place, x in enumerate(found):
                        yield part.path, None, place, turns(x), None
                else:
                    with zipfile.ZipFile(file) as archive, archive.open(part.member) as member:
                        for place, x in enumerate(elements(TextIOWrapper(member, "utf-8"))):
                            yield part.path, part.member, place, turns(x), None
        except (ValueError, zipfile.BadZipFile, EOFError) as e:
            yield part.path, part.member, None, None, f"{type(e).__name__}: {e}"


class ConversationExport(DataSource):
    """Rows (archive, member, place, turns, error) of the exports below a path."""

    @classmethod
    def name(cls) -> str:
        return "conversation_export"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def exported(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the source at ``path``."""
    from ..session import share_code

    share_code(spark)
    spark.dataSource.register(ConversationExport)
    return spark.read.format("conversation_export").load(path)


def turn_table(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of exported conversations; conv_id is made from where a conversation lies."""
    own = F.xxhash64("archive", "member", "place").alias("conv_id")
    found = rows.where("error is null").select(own, F.posexplode("turns").alias("turn", "t"))
    return found.select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")
