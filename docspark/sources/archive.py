"""Zipped office files to blocks of XML elements.

Python opens archives, checks that the parts read are well formed, and cuts their text
into blocks of whole elements in the same pass. All that follows (parsing, ordering,
joins) is Spark's. A part is read as a stream, and blocks have bounded size, so a large
sheet never is one value.

Files come by path or with their content. By path an archive is a seekable stream of its
file system, of any size: its bytes are in no column, and only the parts asked for are
read. ``archive_index`` reads the small parts that say what is in an archive,
``part_blocks`` then reads parts of it, each in a task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.session import write_and_read

BLOCK_SCHEMA = (
    "path string, part string, element string, start bigint, xml string, message string"
)
BLOCK_CHARS = 256 * 1024
# What one task opens: zipped bytes of files and, of parts, inflated ones. A file counts as a few bytes more.
_FILE_BYTES = 4 << 20
_PART_BYTES = 32 << 20
_OPEN_COST = 4 << 10
# Paths of failed files that every task may hold, and what one takes beside its bytes.
_FAILED_BYTES = 8 << 20
_PATH_COST = 64
XML_OPTIONS = {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "false"}
# How a part is cut: to elements of some names, or to the paragraphs, table rows and table
# ends of a text, with the runs of a paragraph in groups <g>: those of a link, which has its
# attributes, and those between links.
TEXT_ITEMS = ["text-items"]


def archive_blocks(
    files: DataFrame,
    wanted: dict[str, list[str]],
    required: str,
    purpose: str,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per block of whole elements, and one for each file.

    The file's own row has element ``file`` if it is readable, else ``error``
    and a ``message``; a file with an error has no other rows.

    ``files`` has ``path`` and maybe ``content``; without, or where it is NULL, the path is
    opened. ``wanted`` maps patterns of part names to the elements to cut from them, or to
    TEXT_ITEMS, and ``required`` names a part that must exist. ``start`` is the position of
    the block's first element among its kind in the part. The blocks are written to
    the shared work folder, so that each table made of them reads its own kind
    of block and no file is unzipped twice.
    """
    cut = _cutter(wanted, required, block_chars)
    return _kept(_opened(files, cut), purpose)


def archive_index(
    files: DataFrame,
    head: dict[str, list[str]],
    body: list[str],
    required: str,
    purpose: str,
) -> DataFrame:
    """Blocks of the parts in ``head``, and a row ``part`` for each part that ``body`` matches.

    ``start`` of a ``part`` row is the part's size. No other part is inflated.
    """
    return _kept(_opened(files, _cutter(head, required, BLOCK_CHARS, body)), purpose)


def part_blocks(
    parts: DataFrame,
    wanted: dict[str, list[str]],
    purpose: str,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Blocks of ``parts`` (``path, part`` and ``size``), which are spread over tasks by path and part.

    A part that cannot be read gives an ``error`` row and its file no others.
    """
    cut = _cutter(wanted, None, block_chars)
    once = parts.groupBy("path", "part").agg(F.max("size").alias("size"))
    spread = _spread(once, ["path", "part"], F.col("size"), _PART_BYTES)
    return _kept(spread.mapInArrow(cut, BLOCK_SCHEMA), purpose)


def without_failed(blocks: DataFrame, failed: DataFrame) -> DataFrame:
    """Blocks of files without an error row. ``failed`` is read once to weigh its paths.

    Blocks are all the XML, so they are shuffled only where so many files failed that their
    paths are more than one task should hold. Spark itself would find out after the shuffle.
    """
    paths = failed.select("path").distinct()
    n, size = paths.agg(F.count(F.lit(1)), F.sum(F.coalesce(F.octet_length("path"), F.lit(0)))).first()
    if not n:
        return blocks
    few = n * _PATH_COST + size <= _FAILED_BYTES
    return blocks.join(F.broadcast(paths) if few else paths, "path", "left_anti")


def _opened(files: DataFrame, cut) -> DataFrame:
    if "content" in files.columns:
        return files.select("path", "content").mapInArrow(cut, BLOCK_SCHEMA)
    length = F.col("length") if "length" in files.columns else F.lit(0)
    return _spread(files, ["path"], length, _FILE_BYTES).mapInArrow(cut, BLOCK_SCHEMA)


def _spread(rows: DataFrame, keys: list[str], size: Column, task_bytes: int) -> DataFrame:
    """The keys alone, over as many tasks as the bytes they stand for ask for.

    A folder is listed by one task, and names are few bytes: Spark itself would leave
    the opening of all files to a few tasks, whatever is in them.
    """
    weight = (F.coalesce(size, F.lit(0)) + _OPEN_COST).cast("bigint")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(weight), F.lit(0))).first()
    at_least = min(n, rows.sparkSession.sparkContext.defaultParallelism)
    return rows.select(*keys).repartition(max(1, at_least, -(-total // task_bytes)), *keys)


def _kept(blocks: DataFrame, purpose: str) -> DataFrame:
    held = write_and_read(blocks, purpose, "element")
    bad = F.col("element") == "error"
    return without_failed(held.where(~bad), held.where(bad)).unionByName(held.where(bad))


def _cutter(
    wanted: dict[str, list[str]], required: str | None, block_chars: int, listed: list[str] = ()
):
    # Nested so that tasks receive the functions themselves: executors need no copy
    # of this package.
    names = ["path", "part", "element", "start", "xml", "message"]
    attributes = r"""(?:[^>"']|"[^"]*"|'[^']*')*?"""
    skipped = r"<!--.*?-->|<!\[CDATA\[.*?\]\]>"

    def tags_of(tags):
        import re

        return re.compile(
            rf"{skipped}|<(?:[\w.-]+:)?(?P<open>{'|'.join(tags)})(?=[\s/>]){attributes}(?P<empty>/?)>"
            rf"|</(?:[\w.-]+:)?(?P<close>{'|'.join(tags)})\s*>",
            re.S,
        )

    # Tags of a text that are replaced, all in one pass. Wrappers, whose runs belong to the paragraph
    # as if they stood in it directly, and empty links go; switches of a run's format become 1 if on.
    wrapper = r"(?:ins|smartTag|sdt|sdtContent)(?=[\s/>])[^>]*>"
    value = r"""(?:\s+(?:\w+:)?val\s*=\s*["'](?:1|true|on)["'])?"""
    opening = rf"{wrapper}|(?P<tab>tab\s*/>)|(?P<on>[bi]){value}\s*/>|(?P<p>p(?:\s(?:[^>]*[^/>])?)?>)"
    links = r"hyperlink(?:\s[^>]*)?/>|hyperlink(?=[\s>])(?P<link>[^>]*)>"
    closing = rf"{wrapper}|(?P<past>p\s*>)|(?P<end>hyperlink\s*>)"
    replaced = rf"<(?:\w+:)?(?:{opening}|{links})|</(?:\w+:)?(?:{closing})"

    def grouped(xml):
        """A block of a text with the runs of its paragraphs in groups."""
        import re

        def tag(found):
            kind = found.lastgroup
            if kind == "p":
                return f"{found[0]}<g>"
            if kind == "past":
                return f"</g>{found[0]}"
            if kind == "link":
                return f"</g><g{found['link']}>"
            if kind == "on":
                return f"<{found['on']}>1</{found['on']}>"
            return {"end": "</g><g>", "tab": "<t>&#9;</t>"}.get(kind, "")

        return re.sub(replaced, tag, xml, flags=re.A)

    def checked_text(stream):
        """The text of a part in pieces; the parser sees the same bytes and finds faults."""
        import codecs
        from xml.parsers import expat

        parser = expat.ParserCreate()
        head = stream.read(2)
        wide = head in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)
        decoder = codecs.getincrementaldecoder("utf-16" if wide else "utf-8-sig")()
        while True:
            chunk = head + stream.read(1 << 20)
            head = b""
            parser.Parse(chunk, not chunk)
            yield decoder.decode(chunk, final=not chunk), not chunk
            if not chunk:
                return

    def elements(stream, tags):
        """Outermost elements with one of these names, in order, as (tag, text)."""
        pattern = tags_of(tags)
        text, at, depth, begin, tag = "", 0, 0, 0, None
        for piece, _ in checked_text(stream):
            text += piece
            for found in pattern.finditer(text, at):
                at = found.end()
                if found["open"] and (depth == 0 or found["open"] == tag):
                    if depth == 0:
                        tag, begin = found["open"], found.start()
                    depth += not found["empty"]
                elif found["close"] and found["close"] == tag and depth:
                    depth -= 1
                else:
                    continue
                if depth == 0:
                    yield tag, text[begin:at]
            keep = begin if depth else at
            text, at, begin = text[keep:], at - keep, 0

    def text_items(stream, _):
        """Paragraphs outside tables (k=p), rows of outermost tables with their number (k=r), table ends (k=e).

        A row holds its cells, a cell all paragraphs in it, those of inner tables too.
        A paragraph's inner elements stay as they are.
        """
        pattern = tags_of(["tbl", "tr", "tc", "p"])
        text, at, begin = "", 0, 0
        tables = paragraphs = cells = row = 0  # how deep, and the row's number
        row_open, own, cell = False, [], []
        for piece, _ in checked_text(stream):
            text += piece
            for found in pattern.finditer(text, at):
                at = found.end()
                name = found["open"] or found["close"]
                opens, closes = bool(found["open"]), bool(found["close"] or found["empty"])
                if name is None:
                    continue
                if name == "p" or paragraphs:
                    if name != "p":  # a table in a text box of a paragraph
                        continue
                    if opens and not paragraphs:
                        begin = found.start()
                    paragraphs += opens - closes
                    if paragraphs == 0 and closes:
                        if cells:
                            cell.append(text[begin:at])
                        elif not tables:
                            yield "i", f'<i k="p">{text[begin:at]}</i>'
                elif name == "tbl":
                    tables += opens - closes
                    if tables == 0:
                        if row:
                            yield "i", '<i k="e"/>'
                        row = 0
                elif name == "tr" and tables == 1:
                    if opens:
                        own = []
                    if closes:
                        yield "i", f'<i k="r" n="{row}">{"".join(own)}</i>'
                        row += 1
                elif name == "tc":
                    cells += opens - closes
                    if tables == 1 and closes:
                        own.append(f"<tc>{''.join(cell)}</tc>")
                        cell = []
            keep = begin if paragraphs else at
            text, at, begin = text[keep:], at - keep, 0

    def blocks(archive, part, tags):
        """Elements of a part gathered to blocks, as (tag, start, xml)."""
        of = text_items if tags == ["text-items"] else elements
        kinds = ["i"] if of is text_items else tags
        whole = grouped if of is text_items else str
        held = {tag: [] for tag in kinds}
        size = dict.fromkeys(kinds, 0)
        start = dict.fromkeys(kinds, 0)
        with archive.open(part) as stream:
            for tag, text in of(stream, tags):
                held[tag].append(text)
                size[tag] += len(text)
                if size[tag] >= block_chars:
                    yield tag, start[tag], whole(f"<b>{''.join(held[tag])}</b>")
                    start[tag] += len(held[tag])
                    held[tag], size[tag] = [], 0
        for tag in kinds:
            if held[tag]:
                yield tag, start[tag], whole(f"<b>{''.join(held[tag])}</b>")

    def opened(path, content):
        """The archive of a file: its bytes if they are given, else a stream of its path."""
        import io
        import re
        import zipfile

        if content is not None:
            return zipfile.ZipFile(io.BytesIO(content))
        from pyarrow import fs

        if "://" in path and not path.startswith("file:"):
            system, path = fs.FileSystem.from_uri(path)
        else:
            system, path = fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
        return zipfile.ZipFile(system.open_input_file(path))

    def tags_for(part):
        import re

        return next((tags for pattern, tags in wanted.items() if re.fullmatch(pattern, part)), None)

    def rows_of(path, part, content):
        """Rows of one part, or of all parts wanted of a file."""
        import re

        with opened(path, content) as archive:
            if part is not None:
                chosen = [part]
            else:
                chosen = [p for p in archive.namelist() if tags_for(p)]
                if required not in archive.namelist():
                    raise ValueError(f"{required} is missing")
                yield path, None, "file", 0, None, None
                for info in archive.infolist():
                    if any(re.fullmatch(pattern, info.filename) for pattern in listed):
                        yield path, info.filename, "part", info.file_size, None, None
            for one in chosen:
                for tag, start, xml in blocks(archive, one, tags_for(one)):
                    yield path, one, tag, start, xml, None

    def record(rows):
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        columns = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def cut(batches):
        rows, size = [], 0
        for batch in batches:
            given = dict(zip(batch.schema.names, batch.columns))
            for i in range(batch.num_rows):
                path, part, content = (given[c][i].as_py() if c in given else None for c in ("path", "part", "content"))
                try:
                    for row in rows_of(path, part, content):
                        rows.append(row)
                        size += len(row[4] or "")
                        if size > (1 << 22):
                            yield record(rows)
                            rows, size = [], 0
                except Exception as problem:  # any unreadable file is an error row
                    rows.append((path, part, "error", 0, None, str(problem)))
        if rows:
            yield record(rows)

    return cut
