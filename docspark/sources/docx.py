"""Word files (.docx) to text and Markdown."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark import errors
from docspark.functions.paths import is_docx
from docspark.operators.ordering import (
    DEFAULT_PART_BYTES,
    Slicing,
    Splitting,
    fold_slices,
    slicing,
    text_in_order,
)
from docspark.session import write_and_read
from docspark.sources.archive import BLOCK_CHARS, TEXT_ITEMS, XML_OPTIONS, archive_blocks

PARTS = {
    r"word/document\.xml": TEXT_ITEMS,
    r"word/_rels/document\.xml\.rels": ["Relationship"],
    r"word/numbering\.xml": ["abstractNum", "num"],
}
REQUIRED_PART = "word/document.xml"
LEVELS = 9  # of a list, fixed by the format
_RUN = "struct<rPr:struct<b:string,i:string>,t:array<string>>"
_LIST = "struct<ilvl:struct<_val:string>,numId:struct<_val:string>>"
# a paragraph's runs in groups, as archive_blocks() cuts them: those of a link, and those between links
_GROUP = f"struct<_id:string,_anchor:string,pPr:struct<pStyle:struct<_val:string>,numPr:{_LIST}>,r:array<{_RUN}>>"
_PARAGRAPH = f"struct<g:array<{_GROUP}>>"
_ITEM = f"struct<_k:string,_n:int,p:array<{_PARAGRAPH}>,tc:array<struct<p:array<{_PARAGRAPH}>>>>"


@dataclass(frozen=True)
class WordTables:
    """``documents`` (doc, part_no, part_count, text, markdown) and ``errors`` for other files."""

    documents: DataFrame
    errors: DataFrame


def extract_docx(
    files: DataFrame,
    part_bytes: int = DEFAULT_PART_BYTES,
    how: Splitting | None = Splitting(),
    tables: bool = True,
    block_chars: int = BLOCK_CHARS,
) -> WordTables:
    """Raw text and Markdown of every .docx in ``files`` (``path``, and ``content`` if at hand).

    Text is each paragraph followed by two line breaks, tables included in
    reading order. Markdown is the same with styles Heading1 to Heading6 as
    ``#`` to ``######``, list items as ``- `` or, in a numbered list, with their number,
    indented by two spaces for each level above, links as ``[text](target)``, runs in
    ``**`` if bold and in ``_`` if italic; any other formatting is plain text. A table is
    one in Markdown, with its first row as the header, ``<br>`` between the paragraphs of a
    cell and ``\\|`` for ``|``; inner tables are paragraphs of their cell. Without
    ``tables``, its paragraphs stand one after another. Files that are not .docx or cannot
    be read give an error row each.

    An item's number counts the items of its list and level since the last item of a level
    above, from the level's first number on.
    """
    named_right = is_docx(F.col("path"))
    wrong_type = files.filter(~named_right).select(
        F.col("path").alias("key"),
        errors.error(
            errors.UNSUPPORTED_FORMAT, F.concat(F.lit(errors.ONLY_DOCX_PREFIX), F.col("path"))
        ).alias("error"),
    )
    blocks = archive_blocks(files.filter(named_right), PARTS, REQUIRED_PART, "docx", block_chars)
    unreadable = blocks.filter(F.col("element") == "error").select(
        F.col("path").alias("key"),
        errors.error(
            errors.WORD_TEXT_EXTRACTION_FAILED,
            F.concat(F.lit(errors.WORD_READ_PREFIX), F.col("message")),
            filePath=F.col("path"),
        ).alias("error"),
    )
    # a block has about as many bytes as characters in XML: nothing is read to weigh it
    placed = _item_blocks(blocks).select(F.col("path").alias("doc"), "start")
    cut = slicing(placed, ["doc"], ["start"], how, weight=F.lit(block_chars))
    folded = fold_slices(
        _block_texts(blocks, tables, cut),
        cut,
        F.octet_length("text"),
        part_bytes,
        text=text_in_order("text", ["start"]),
        markdown=text_in_order("markdown", ["start"]),
    )
    # a readable file without paragraphs still is a document
    readable = blocks.filter(F.col("element") == "file").select(F.col("path").alias("doc"))
    none = readable.join(_item_blocks(blocks).select(F.col("path").alias("doc")).distinct(), "doc", "left_anti")
    one = F.lit(1).cast("bigint")
    empty = none.select("doc", one.alias("part_no"), one.alias("part_count"), F.lit("").alias("text"), F.lit("").alias("markdown"))
    return WordTables(folded.unionByName(empty), wrong_type.unionByName(unreadable))


def _item_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.filter(F.col("element") == "i")


def _by_merge(rows: DataFrame) -> DataFrame:
    """A table that grows with the files, so that Spark never broadcasts it.

    Such tables are packed well, exploded, or cut to few columns, so they are sized too low.
    """
    return rows.hint("merge")


def _items(xml: Column) -> Column:
    """Items of a block with the runs of each paragraph in groups, one for each link."""
    return F.from_xml(xml, f"i array<{_ITEM}>", XML_OPTIONS)["i"]


def _paragraphs(item: Column) -> Column:
    """All paragraphs of an item: itself, or those of a row's cells."""
    nothing = F.array().cast(f"array<{_PARAGRAPH}>")
    in_cells = F.flatten(F.transform(item["tc"], lambda c: F.coalesce(c["p"], nothing)))
    return F.coalesce(item["p"], in_cells, nothing)


def _run_text(r: Column) -> Column:
    return F.coalesce(F.array_join(r["t"], ""), F.lit(""))


def _runs(g: Column) -> Column:
    return F.coalesce(g["r"], F.array().cast(f"array<{_RUN}>"))


def _paragraph_text(p: Column) -> Column:
    groups = F.transform(p["g"], lambda g: F.array_join(F.transform(_runs(g), _run_text), ""))
    return F.coalesce(F.array_join(groups, ""), F.lit(""))


def _marked(text: Column, bold: Column, italic: Column) -> Column:
    """Text in the marks of its format; white space at its ends stays outside of them."""
    inner = F.btrim(text)
    lead = F.left(text, F.length(text) - F.length(F.ltrim(text)))
    trail = F.substr(text, F.length(F.rtrim(text)) + 1)
    opened = F.concat(F.when(bold, "**").otherwise(""), F.when(italic, "_").otherwise(""))
    closed = F.concat(F.when(italic, "_").otherwise(""), F.when(bold, "**").otherwise(""))
    return F.when(~(bold | italic) | (inner == ""), text).otherwise(F.concat(lead, opened, inner, closed, trail))


def _once(value: Column, use) -> Column:
    """``use(value)``, with a value that is made once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _group_markdown(g: Column, targets: Column) -> Column:
    """A group's runs, those of one format side by side as one, in a link if it is one."""
    runs = F.transform(
        F.filter(_runs(g), lambda r: _run_text(r) != ""),
        lambda r: F.struct(
            F.coalesce(r["rPr"]["b"] == "1", F.lit(False)).alias("bold"),
            F.coalesce(r["rPr"]["i"] == "1", F.lit(False)).alias("italic"),
            _run_text(r).alias("text"),
        ),
    )

    def stretches(runs):
        same = lambda a, b: (a["bold"] == b["bold"]) & (a["italic"] == b["italic"])
        at = F.transform(runs, lambda _, i: i)
        first = F.filter(at, lambda i: (i == 0) | ~same(F.get(runs, i), F.get(runs, i - 1)))

        def joined(first):
            def stretch(i, k):
                after = F.coalesce(F.get(first, k + 1), F.size(runs))
                text = F.array_join(F.transform(F.slice(runs, i + 1, after - i), lambda r: r["text"]), "")
                return _once(text, lambda t: _marked(t, F.get(runs, i)["bold"], F.get(runs, i)["italic"]))

            return F.array_join(F.transform(first, stretch), "")

        return _once(first, joined)

    text = _once(runs, stretches)
    target = F.coalesce(F.element_at(targets, g["_id"]), F.when(g["_id"].isNull(), F.concat(F.lit("#"), g["_anchor"])))
    linked = lambda t: F.when(
        target.isNotNull() & (F.btrim(t) != ""), F.concat(F.lit("["), t, F.lit("]("), target, F.lit(")"))
    ).otherwise(t)
    return _once(text, linked)


def _paragraph_markdown(p: Column, targets: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(p["g"], lambda g: _group_markdown(g, targets)), ""), F.lit(""))


def _properties(p: Column) -> Column:
    return F.get(p["g"], 0)["pPr"]


def _list_of(p: Column) -> tuple[Column, Column]:
    """The list and the level of a list item; NULL for other paragraphs."""
    listed = _properties(p)["numPr"]
    number = F.when(listed["numId"]["_val"] != "0", listed["numId"]["_val"])
    level = F.coalesce(listed["ilvl"]["_val"].try_cast("int"), F.lit(0))
    return number, F.least(F.greatest(level, F.lit(0)), F.lit(LEVELS - 1))


def _list_mark(p: Column, number: Column) -> Column:
    """``number`` is that of the item in a numbered list, NULL in any other."""
    list_id, level = _list_of(p)
    mark = F.coalesce(F.concat(number.cast("string"), F.lit(". ")), F.lit("- "))
    return F.when(list_id.isNotNull(), F.concat(F.repeat(F.lit("  "), level), mark))


def _heading_mark(p: Column) -> Column:
    level = F.regexp_extract(_properties(p)["pStyle"]["_val"], "^Heading([1-6])$", 1).try_cast("int")
    return F.concat(F.repeat(F.lit("#"), level), F.lit(" "))


def _block_texts(blocks: DataFrame, tables: bool, cut: Slicing) -> DataFrame:
    """Text and Markdown of each block, spread by ``cut``: its paragraphs are at hand in order already.

    Without hot documents the XML is shuffled once, by document: a block meets its numbers and
    links there, and its texts are where they are folded. Texts of hot ones are spread by slice,
    as folding reads them several times.
    """
    side = (
        _numbers(blocks)
        .join(_targets(blocks), ["path", "start"], "full")
        .select(F.col("path").alias("doc"), F.col("start").alias("_at"), "_numbers", "_targets")
    )
    items = _item_blocks(blocks).select(F.col("path").alias("doc"), "start", "xml")
    if cut.bounds is None:
        # equal in a way that leaves the document as the only key, which spread() has dealt rows by
        same = F.col("start").bitwiseXOR(F.col("_at")) == 0
        items, side = cut.spread(items), cut.spread(side)
    else:
        same = F.col("start") == F.col("_at")
    met = items.join(_by_merge(side.withColumnRenamed("doc", "_doc")), (F.col("doc") == F.col("_doc")) & same, "left")
    parsed = met.select(
        "doc",
        "start",
        _items(F.col("xml")).alias("_items"),
        F.coalesce("_numbers", F.create_map().cast("map<int,bigint>")).alias("_numbers"),
        F.coalesce("_targets", F.create_map().cast("map<string,string>")).alias("_targets"),
    )
    # an item's first paragraph has the number of all paragraphs before it
    sizes = F.transform("_items", lambda i: F.size(_paragraphs(i)))
    before = F.transform("_items", lambda _, k: F.aggregate(F.slice("_sizes", F.lit(1), k), F.lit(0), lambda s, n: s + n))
    end, targets = F.lit("\n\n"), F.col("_targets")

    def line(p, at):
        mark = F.coalesce(_heading_mark(p), _list_mark(p, F.element_at("_numbers", at)), F.lit(""))
        return F.concat(mark, _paragraph_markdown(p, targets), end)

    def cell(ps, at):
        lines = F.transform(
            ps, lambda p, k: F.concat(F.coalesce(_list_mark(p, F.element_at("_numbers", at + k)), F.lit("")), _paragraph_markdown(p, targets))
        )
        return F.replace(F.array_join(F.filter(lines, lambda t: t != ""), "<br>"), F.lit("|"), F.lit("\\|"))

    def row(item, at):
        cells = F.coalesce(item["tc"], F.array().cast(f"array<struct<p:array<{_PARAGRAPH}>>>"))
        of = lambda c: F.coalesce(c["p"], F.array().cast(f"array<{_PARAGRAPH}>"))
        place = lambda k: at + F.aggregate(F.slice(cells, F.lit(1), k), F.lit(0), lambda s, c: s + F.size(of(c)))
        texts = F.array_join(F.transform(cells, lambda c, k: cell(of(c), place(k))), " | ")
        rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(cells)), F.lit("\n"))
        drawn = F.concat(F.lit("| "), texts, F.lit(" |\n"), F.when(item["_n"] == 0, rule).otherwise(""))
        return F.when(F.size(cells) > 0, drawn).otherwise("")

    def markdown(item, k):
        at = F.get("_before", k)
        lines = F.array_join(F.transform(_paragraphs(item), lambda p, j: line(p, at + j)), "")
        if not tables:
            return lines
        return F.when(item["_k"] == "r", row(item, at)).when(item["_k"] == "e", F.lit("\n")).otherwise(lines)

    def text(item):
        return F.array_join(F.transform(_paragraphs(item), lambda p: F.concat(_paragraph_text(p), end)), "")

    texts = (
        parsed.withColumn("_sizes", sizes)
        .withColumn("_before", before)
        .select(
            "doc",
            "start",
            F.array_join(F.transform("_items", text), "").alias("text"),
            F.array_join(F.transform("_items", markdown), "").alias("markdown"),
        )
    )
    return texts if cut.bounds is None else cut.spread(texts)


def _targets(blocks: DataFrame) -> DataFrame:
    """``path, start, _targets``: where the links of a block lead, for blocks that have some."""
    ids = F.regexp_extract_all("xml", F.lit(r"<g\s[^>]*?\bid\s*=\s*[\"']([^\"']*)[\"']"), 1)
    asked = (
        _item_blocks(blocks)
        .where(F.contains("xml", F.lit("</g><g")))
        .select("path", "start", F.explode(F.array_distinct(ids)).alias("id"))
    )
    known = _parsed(blocks, "Relationship", "array<struct<_Id:string,_Target:string>>").select(
        "path", F.col("item._Id").alias("id"), F.col("item._Target").alias("target")
    )
    one = known.where("target is not null").groupBy("path", "id").agg(F.min("target").alias("target"))
    pairs = F.array_sort(F.collect_list(F.struct("id", "target")))
    return asked.join(_by_merge(one), ["path", "id"]).groupBy("path", "start").agg(F.map_from_entries(pairs).alias("_targets"))


def _parsed(blocks: DataFrame, element: str, schema: str) -> DataFrame:
    found = F.from_xml("xml", f"{element} {schema}", XML_OPTIONS)[element]
    return blocks.filter(F.col("element") == element).select("path", F.explode_outer(found).alias("item"))


def _levels(blocks: DataFrame) -> DataFrame:
    """``path, list, level, is_numbered, first`` of every level that a list defines."""
    kinds = (
        _parsed(
            blocks,
            "abstractNum",
            "array<struct<_abstractNumId:string,lvl:array<struct<_ilvl:int,start:struct<_val:string>,numFmt:struct<_val:string>>>>>",
        )
        .select("path", F.col("item._abstractNumId").alias("kind"), F.explode("item.lvl").alias("l"))
        .select(
            "path", "kind", F.col("l._ilvl").alias("level"), (F.coalesce("l.numFmt._val", F.lit("decimal")) != "bullet").alias("is_numbered"),
            F.col("l.start._val").try_cast("bigint").alias("start"),
        )
    )
    lists = _parsed(
        blocks,
        "num",
        "array<struct<_numId:string,abstractNumId:struct<_val:string>,"
        "lvlOverride:array<struct<_ilvl:int,startOverride:struct<_val:string>>>>>",
    ).select("path", F.col("item._numId").alias("list"), F.col("item.abstractNumId._val").alias("kind"), F.col("item.lvlOverride").alias("over"))
    own = F.get(F.filter("over", lambda o: (o["_ilvl"] == F.col("level")) & o["startOverride"].isNotNull()), 0)
    first = F.coalesce(own["startOverride"]["_val"].try_cast("bigint"), "start", F.lit(1))
    return lists.join(_by_merge(kinds), ["path", "kind"]).groupBy("path", "list", "level").agg(
        F.max("is_numbered").alias("is_numbered"), F.max(first).alias("first")
    )


def _numbers(blocks: DataFrame) -> DataFrame:
    """``path, start, _numbers``: of a block's paragraphs that are items of numbered lists, their numbers.

    Within a block, items of a level are counted since the last item of a level above. What
    a block hands on is, for each level, whether it had an item of a level above and how
    many items came after the last one: two blocks' states make one, so a list goes on
    from block to block by a running sum over one row for each block, list and level.
    """
    inside = F.flatten(F.transform(_items(F.col("xml")), _paragraphs))
    number, level = _list_of(F.col("p"))
    items = (
        _item_blocks(blocks)
        .where(F.contains("xml", F.lit("numPr")))
        .select("path", "start", F.posexplode(inside).alias("at", "p"))
        .select("path", "start", "at", number.alias("list"), level.alias("level"))
        .where("list is not null")
    )
    items = write_and_read(items, "list-items")
    block = ["path", "start", "list"]
    so_far = Window.partitionBy(*block).orderBy("at")
    above = F.array(*[F.count(F.when(F.col("level") < n, 1)).over(so_far) for n in range(LEVELS)])
    own = (
        items.withColumn("stretch", F.get(above, F.col("level")))
        .withColumn("nth", F.row_number().over(Window.partitionBy(*block, "level", "stretch").orderBy("at")))
    )
    # a block's state: a row for each level from the highest in it downwards
    held = items.groupBy(*block, "level").agg(F.count(F.lit(1)).alias("k"))
    per_level = F.transform(
        F.sequence(F.lit(0), F.lit(LEVELS - 1)),
        lambda n: F.struct(n.alias("level"), F.aggregate("held", F.lit(0).cast("bigint"), lambda s, h: s + F.when(h["level"] < n, h["k"]).otherwise(0)).alias("stretches")),
    )
    ends = own.groupBy(*block, "level", "stretch").agg(F.max("nth").alias("n")).withColumnRenamed("stretch", "stretches")
    state = (
        held.groupBy(*block)
        .agg(F.collect_list(F.struct("level", "k")).alias("held"))
        .select(*block, F.explode(per_level).alias("s"))
        .select(*block, "s.level", "s.stretches")
        .join(_by_merge(ends), [*block, "level", "stretches"], "left")
        .select(*block, "level", (F.col("stretches") > 0).alias("fresh"), F.coalesce("n", F.lit(0)).alias("n"))
    )
    in_list = Window.partitionBy("path", "list", "level").orderBy("start")
    carried = (
        state.withColumn("run", F.sum(F.col("fresh").cast("int")).over(in_list))
        .withColumn("sum", F.sum("n").over(Window.partitionBy("path", "list", "level", "run").orderBy("start")))
        .withColumn("before", F.coalesce(F.lag("sum").over(in_list), F.lit(0)))
        .select(*block, "level", "before")
    )
    number = F.col("first") - 1 + F.col("nth") + F.when(F.col("stretch") == 0, F.col("before")).otherwise(0)
    numbered = (
        own.join(_by_merge(carried), [*block, "level"])
        .join(_by_merge(_levels(blocks).where("is_numbered")), ["path", "list", "level"])
        .select("path", "start", "at", number.cast("bigint").alias("number"))
    )
    pairs = F.array_sort(F.collect_list(F.struct("at", "number")))
    return numbered.groupBy("path", "start").agg(F.map_from_entries(pairs).alias("_numbers"))
