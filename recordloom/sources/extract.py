"""Text of files: dispatch by extension over a binary scan, with errors in a column of their own.

Formats read with the standard library: text, CSV, HTML, DOCX, XLSX, PPTX and legacy DOC. PDF needs a reader that
is passed in. Corrupt, empty, oversized and unknown files, and files whose first bytes belong to another type, give a
null text and an error. Text that a limit cuts has a warning that names the limit.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.functions.text import quality

MOST_BYTES, WARN_BYTES = 500 * 1024 * 1024, 50 * 1024 * 1024
# fixed values: limits of one file
MOST_PARAGRAPHS, MOST_TABLES, MOST_TABLE_ROWS, MOST_CELLS = 5000, 100, 50, 20
MOST_SHEETS, MOST_ROWS, MOST_COLUMNS, MOST_SLIDES = 50, 10_000, 500, 500
# fixed values: extension -> media type
MEDIA_TYPES = {
    ".txt": "text/plain", ".csv": "text/csv", ".html": "text/html", ".htm": "text/html", ".pdf": "application/pdf", ".doc": "application/msword",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
}


# fixed values: first bytes of a file -> extensions they belong to
SIGNATURES = {b"PK": [".docx", ".xlsx", ".pptx"], b"%PDF": [".pdf"], b"\xd0\xcf\x11\xe0": [".doc"]}


class Limited(str):
    """Text that a limit has cut, with the names of the limits."""

    cut: str = ""

    @classmethod
    def of(cls, text: str, cut: list[str]) -> str:
        if not cut:
            return text
        out = cls(text)
        out.cut = "cut at the limit of " + ", ".join(dict.fromkeys(cut))
        return out


def check_content(name: str, data: bytes) -> None:
    """Raise ValueError when the first bytes belong to another type than the name says; other faults are left to the reader."""
    ext = "." + name.lower().rsplit(".", 1)[-1]
    for sign, exts in SIGNATURES.items():
        if ext not in exts and data.startswith(sign) and any(ext in e for e in SIGNATURES.values()):
            raise ValueError(f"content is not of type {ext}")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _under(node: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (x for x in node.iter() if _local(x.tag) == name)


def decode_text(data: bytes) -> str:
    """By byte order mark, else UTF-8, else Windows-1252."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


def read_docx(data: bytes) -> str:
    """Paragraphs, headings marked, then tables as lines of cells."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    out: list[str] = []
    cut: list[str] = []
    inside = {id(p) for t in _under(body, "tbl") for p in _under(t, "p")}
    for n, p in enumerate(_under(body, "p")):
        if n >= MOST_PARAGRAPHS:
            cut.append("paragraphs")
            break
        text = "".join(t.text or "" for t in _under(p, "t")).strip()
        if text and id(p) not in inside:
            style = next((v for s in _under(p, "pStyle") for k, v in s.attrib.items() if _local(k) == "val"), "")
            out.append(f"[HEADING] {text}" if style.lower().startswith(("heading", "title")) else text)
    for n, table in enumerate(_under(body, "tbl")):
        if n >= MOST_TABLES:
            cut.append("tables")
            break
        out.append(f"[TABLE {n + 1}]")
        rows = list(_under(table, "tr"))
        cut += ["table rows"] * (len(rows) > MOST_TABLE_ROWS)
        for row in rows[:MOST_TABLE_ROWS]:
            cells = list(_under(row, "tc"))
            cut += ["table cells"] * (len(cells) > MOST_CELLS)
            out.append(" | ".join("".join(t.text or "" for t in _under(c, "t")) for c in cells[:MOST_CELLS]))
    return Limited.of("\n".join(out), cut)


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref.upper())[0]:
        n = n * 26 + ord(c) - 64
    return n


def read_xlsx(data: bytes) -> str:
    """Sheets as lines of cells; shared strings and booleans are resolved, numbers stay numbers."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = z.namelist()
    shared = [("".join(t.text or "" for t in _under(si, "t"))) for si in _under(ElementTree.fromstring(z.read("xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in names else []
    out: list[str] = []
    sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    cut = ["sheets"] * (len(sheets) > MOST_SHEETS)
    for k, name in enumerate(sheets[:MOST_SHEETS]):
        out.append(f"[SHEET {k + 1}]")
        rows = list(_under(ElementTree.fromstring(z.read(name)), "row"))
        cut += ["rows"] * (len(rows) > MOST_ROWS)
        for row in rows[:MOST_ROWS]:
            cells = []
            for c in _under(row, "c"):
                if _column(c.get("r", "A")) > MOST_COLUMNS:
                    cut.append("columns")
                    break
                kind, v = c.get("t"), next((x.text or "" for x in c if _local(x.tag) == "v"), "")
                if kind == "s":
                    v = shared[int(v)] if v.isdigit() and int(v) < len(shared) else ""
                elif kind == "b":
                    v = "TRUE" if v == "1" else "FALSE"
                elif kind == "inlineStr":
                    v = "".join(t.text or "" for t in _under(c, "t"))
                if v:
                    cells.append(v)
            if cells:
                out.append(" | ".join(cells))
    return Limited.of("\n".join(out), cut)


def read_pptx(data: bytes) -> str:
    z = zipfile.ZipFile(io.BytesIO(data))
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    out = []
    for k, name in enumerate(slides[:MOST_SLIDES]):
        paragraphs = ["".join(t.text or "" for t in _under(p, "t")) for p in _under(ElementTree.fromstring(z.read(name)), "p")]
        out.append(f"[SLIDE {k + 1}]\n" + "\n".join(p for p in paragraphs if p.strip()))
    return Limited.of("\n".join(out), ["slides"] * (len(slides) > MOST_SLIDES))


class _Html(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skip += tag in ("script", "style")
        if tag in ("p", "br", "div", "li", "tr", "h1", "h2", "h3", "h4"):
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.skip -= tag in ("script", "style") and self.skip > 0

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.parts.append(data)


def read_html(data: bytes) -> str:
    h = _Html()
    h.feed(decode_text(data))
    return re.sub(r"\n\s*\n+", "\n", "".join(h.parts)).strip()


def read_doc(data: bytes) -> str:
    """Legacy DOC: the decoding whose runs of readable words are longest in sum."""
    best = ""
    for name in ("utf-16-le", "cp1252", "utf-8"):
        found = re.findall(r"[A-Za-z0-9À-ÿ.,!?;:()\"'\-]+(?: [A-Za-z0-9À-ÿ.,!?;:()\"'\-]+)+", data.decode(name, "ignore"))
        text = " ".join(w for w in found if len(w) > 8)
        best = max(best, text, key=len)
    if len(best) < 50:
        raise ValueError("too little readable text")
    return best


READERS: dict[str, Callable[[bytes], str]] = {".txt": decode_text, ".csv": decode_text, ".html": read_html, ".htm": read_html, ".docx": read_docx, ".xlsx": read_xlsx, ".pptx": read_pptx, ".doc": read_doc}


def wrap_pages(pages: list[str]) -> str:
    """Pages between page marks, the form the chunker understands."""
    return "\n".join(f"[PAGE {i + 1}]\n{p}\n[END PAGE {i + 1}]" for i, p in enumerate(pages))


def file_error(name: Column, size: Column, known: list[str]) -> Column:
    """Why a file cannot be read by its name and size, or null."""
    ext = F.regexp_extract(F.lower(name), r"(\.[^./\\]+)$", 1)
    return F.when(size <= 0, "empty file").when(size > MOST_BYTES, "file too large").when(~ext.isin(known), F.concat(F.lit("unsupported type "), ext))


def extract_files(spark: SparkSession, path: str, readers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """``(path, length, media_type, warning, text, error)`` of every file under a folder."""
    table = READERS | (readers or {})
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.withColumn("error", file_error(F.col("path"), F.col("length"), sorted(table)))

    @F.pandas_udf("text string, failure string, cut string")
    def read(names: pd.Series, data: pd.Series, errors: pd.Series) -> pd.DataFrame:
        out = []
        for n, d, e in zip(names, data, errors):
            if e is not None:
                out.append((None, None, None))
                continue
            try:
                check_content(n, bytes(d[:8]))
                got = table["." + n.lower().rsplit(".", 1)[-1]](bytes(d))
                out.append((str(got), None, getattr(got, "cut", None)))
            except Exception as x:  # one bad file must not end the job
                out.append((None, f"{type(x).__name__}: {x}"[:300], None))
        return pd.DataFrame(out, columns=["text", "failure", "cut"])

    got = files.withColumn("r", read("path", "content", "error"))
    media = F.create_map(*[F.lit(v) for kv in MEDIA_TYPES.items() for v in kv])
    ext = F.regexp_extract(F.lower("path"), r"(\.[^./\\]+)$", 1)
    return got.select("path", "length", F.try_element_at(media, ext).alias("media_type"), F.nullif(F.concat_ws("; ", F.when(F.col("length") > WARN_BYTES, "large file"), "r.cut"), F.lit("")).alias("warning"), "r.text", F.coalesce("error", "r.failure").alias("error"))


def blob_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length, modified, etag, media_type)`` of stored files; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    media = F.create_map(*[F.lit(v) for kv in MEDIA_TYPES.items() for v in kv])
    tag = F.base64(F.concat_ws("-", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")).cast("binary"))
    return f.select("path", "length", F.col("modificationTime").alias("modified"), tag.alias("etag"), F.coalesce(F.try_element_at(media, F.regexp_extract(F.lower("path"), r"(\.[^./\\]+)$", 1)), F.lit("application/octet-stream")).alias("media_type"))


class Blobs:
    """Stored files of one folder, one by one: save, read, remove. Tables of files are read by :func:`extract_files`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):  # type: ignore[no-untyped-def]
        if name.startswith("/") or ".." in name.split("/"):
            raise ValueError(f"not a name within the folder: {name}")
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def save(self, name: str, data: bytes) -> str:
        """Write a file beside and put it in place by one rename; the path it has."""
        side = self._at(f"{name}.{uuid.uuid4().hex}.part")
        out = self._fs.create(side, False)
        out.write(bytearray(data))
        out.close()
        self._fs.delete(self._at(name), False)
        if not self._fs.rename(side, self._at(name)):
            raise OSError(f"could not store {name}")
        return f"{self.path}/{name}"

    def exists(self, name: str) -> bool:
        return bool(self._fs.exists(self._at(name)))

    def read(self, name: str) -> bytes:
        if not self.exists(name):
            raise FileNotFoundError(name)
        return bytes(self.spark.read.format("binaryFile").load(f"{self.path}/{name}").select("content").first()[0])

    def remove(self, name: str) -> bool:
        return bool(self._fs.delete(self._at(name), False))


def safe_name(name: str) -> str:
    """A file name without signs that file systems refuse; ``file`` when nothing is left."""
    return re.sub(r'[<>:"/\\|?*\x00-\x1f]', "_", name).strip(" .") or "file"


def bundle(files: Iterable[tuple[str, bytes]]) -> bytes:
    """A zip of the files of one download, names made safe and different whatever the case."""
    out = io.BytesIO()
    used: set[str] = set()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files:
            stem, dot, ext = safe_name(name).rpartition(".")
            stem, tail = (stem, dot + ext) if stem else (ext, "")
            n, made = 1, stem + tail
            while made.lower() in used:
                n += 1
                made = f"{stem} ({n}){tail}"
            used.add(made.lower())
            z.writestr(made, data)
    return out.getvalue()


def best_extraction(candidates: DataFrame, key: list[str], strategy: str = "strategy", body: str = "text", fonts: str = "font") -> DataFrame:
    """``(key, text)``: of several extractions of a page the one of best quality, headings never lost.

    The extraction by fonts wins ties. Where it loses, its heading lines that the winner does not hold, whatever the
    case, are put before the winner, the last one first.
    """
    score = F.when(F.trim(F.coalesce(body, F.lit(""))) != "", quality(body)).otherwise(F.lit(-1))
    other = F.col(strategy) != fonts
    g = candidates.groupBy(*key).agg(
        F.max(F.when(other, F.struct(score.alias("s"), F.length(F.coalesce(body, F.lit(""))).alias("n"), F.col(body).alias("t")))).alias("_a"),
        F.max(F.when(~other, F.struct(score.alias("s"), F.col(body).alias("t")))).alias("_f"),
    )
    base, font = F.coalesce("_a.t", F.lit("")), F.coalesce("_f.t", F.lit(""))
    heads = F.filter(F.transform(F.split(font, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("[HEADING]"))
    lost = F.filter(heads, lambda h: ~F.contains(F.lower(base), F.lower(F.trim(F.replace(h, F.lit("[HEADING]"), F.lit(""))))))
    merged = F.array_join(F.concat(F.reverse(lost), F.array(base)), "\n")
    return g.select(*key, F.when((F.col("_f.s") >= 0) & (F.col("_f.s") >= F.coalesce("_a.s", F.lit(-1))), font).otherwise(merged).alias("text"))


def glyph_lines(glyphs: DataFrame, page: str = "page", gap: float = 4.0, heading_height: float = 13.0) -> DataFrame:
    """``(page, line_no, text)`` from glyph runs ``(page, x, y, text, height, bold)``: a new line where y moves by more than ``gap``.

    A line that holds a bold or tall run is marked as a heading.
    """
    by_y = Window.partitionBy(page).orderBy(F.desc("y"), "x")
    moved = F.coalesce(F.abs(F.col("y") - F.lag("y").over(by_y)) > gap, F.lit(False))
    lines = glyphs.withColumn("_new", moved.cast("int")).withColumn("line_no", F.sum("_new").over(by_y))
    got = lines.groupBy(page, "line_no").agg(F.sort_array(F.collect_list(F.struct("x", "text"))).alias("runs"), F.bool_or(F.col("bold") | (F.col("height") >= heading_height)).alias("head"))
    text = F.trim(F.array_join(F.transform("runs", lambda r: r["text"]), ""))
    return got.select(page, "line_no", F.when(F.col("head"), F.concat(F.lit("[HEADING] "), text)).otherwise(text).alias("text"))
