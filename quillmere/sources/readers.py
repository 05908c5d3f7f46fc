"""File sources and sinks: scans with hashes, office formats by the standard library, JSON lines, catalogues, Markdown tables, OCR by a provider."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions import ids

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
# How each extension is read.
METHODS = {".docx": "docx", ".xlsx": "xlsx", ".rtf": "rtf", ".pdf": "pdf", ".txt": "text", ".md": "text", ".png": "ocr", ".jpg": "ocr", ".jpeg": "ocr", ".rar": "manifest_only", ".zip": "manifest_only", ".7z": "manifest_only"}


def skipped(relative_path: Column) -> Column:
    """Hidden parts, lock and temporary files."""
    parts, name = F.split(relative_path, "/"), F.substring_index(relative_path, "/", -1)
    return F.exists(parts, lambda p: p.startswith(".")) | name.isin(".DS_Store", "Thumbs.db", "desktop.ini") | name.rlike(r"^(~\$|\.~)") | name.rlike(r"(#|\.tmp|\.temp)$")


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """A manifest row for each file below root, with its bytes; the columns are pruned where they are not used."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"^file:/*", "/", root.rstrip("/")) + "/"
    path = F.regexp_replace(F.substring_index("path", base, -1), "%20", " ")
    x = x.select(path.alias("relative_path"), F.col("length").alias("size_bytes"), (F.unix_micros("modificationTime") * 1000).alias("modified_ns"), F.sha2("content", 256).alias("file_hash"), "content").where(~skipped(F.col("relative_path")))
    name = F.substring_index("relative_path", "/", -1)
    extension = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    folder = F.when(F.contains("relative_path", F.lit("/")), F.substring_index("relative_path", "/", 1)).otherwise("")
    return x.select(ids.file_id(F.col("relative_path")).alias("file_id"), "relative_path", name.alias("filename"), extension.alias("extension"), "size_bytes", "modified_ns", "file_hash", folder.alias("inferred_category"), "content")


def method(extension: Column) -> Column:
    return F.coalesce(*[F.when(extension == k, v) for k, v in METHODS.items()], F.lit("unsupported"))


def docx_parts(data: bytes) -> list[tuple[str, str]]:
    """(kind, text) in body order: paragraph, heading or table (rows as lines, cells joined by ' | ', blank rows dropped)."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{W}t"))
    out = []
    for e in body if body is not None else []:
        if e.tag == f"{W}p" and text(e).strip():
            style = e.find(f"{W}pPr/{W}pStyle")
            out.append(("heading" if style is not None and style.get(f"{W}val", "").lower().startswith(("heading", "title")) else "paragraph", text(e).strip()))
        elif e.tag == f"{W}tbl":
            rows = [[text(c).strip() for c in r.iter(f"{W}tc")] for r in e.iter(f"{W}tr")]
            if lines := [" | ".join(r) for r in rows if any(r)]:
                out.append(("table", "\n".join(lines)))
    return out


def xlsx_parts(data: bytes) -> list[tuple[str, str]]:
    """(sheet name, text) for each sheet with cells: non-blank cells joined by ' | ', blank rows dropped."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{S}si")] if "xl/sharedStrings.xml" in z.namelist() else []
    names = [s.get("name", "") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{S}sheet")]
    sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    out = []
    for name, path in zip(names, sheets, strict=False):
        lines = []
        for row in ElementTree.fromstring(z.read(path)).iter(f"{S}row"):
            cells = []
            for c in row.iter(f"{S}c"):
                v = c.find(f"{S}v")
                t = "".join(x.text or "" for x in c.iter(f"{S}t")) if c.get("t") == "inlineStr" else "" if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text or ""
                if t.strip():
                    cells.append(t.strip())
            if cells:
                lines.append(" | ".join(cells))
        if lines:
            out.append((name, "\n".join(lines)))
    return out


def rtf_text(data: bytes) -> str:
    """Text of an RTF file: groups that hold no text are left out, escapes are resolved."""
    src, out, stack, skip, i, uc = data.decode("latin-1"), [], [], False, 0, 1
    while i < len(src):
        c = src[i]
        if c == "{":
            stack.append((skip, uc))
            i += 1
        elif c == "}":
            skip, uc = stack.pop() if stack else (False, 1)
            i += 1
        elif c == "\\":
            m = re.compile(r"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\(.)", re.S).match(src, i)
            i = m.end() if m else i + 1
            if not m:
                continue
            word, arg, code, sign = m.groups()
            if word in ("fonttbl", "colortbl", "stylesheet", "info", "pict", "object") or sign == "*":
                skip = True
            elif word == "uc":
                uc = int(arg or 1)
            elif not skip:
                if word in ("par", "line", "row"):
                    out.append("\n")
                elif word in ("tab", "cell"):
                    out.append("\t")
                elif word == "u":
                    out.append(chr(int(arg) % 65536))
                    for _ in range(uc):
                        i += 4 if src[i : i + 2] == "\\'" else 1 if i < len(src) and src[i] not in "\\{}" else 0
                elif code:
                    out.append(bytes([int(code, 16)]).decode("cp1251", "replace"))
                elif sign and sign in "\\{}":
                    out.append(sign)
                elif sign == "~":
                    out.append(" ")
        else:
            if not skip and c not in "\r\n":
                out.append(c)
            i += 1
    return "".join(out).strip()


Ocr = Callable[[bytes], tuple[str, str]]


def extract(files: DataFrame, ocr: Ocr | None = None) -> DataFrame:
    """(file_id, relative_path, status, method, message, ordinal, source_type, section, text): a row for each element, or one row with a status for a file without any.

    A broken file gives status failed and its message; the others go on. Images and scans go to the provider `ocr`, if there is one.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            rows = []
            for r in x.itertuples(index=False):
                status, message, parts = "indexed", None, []
                try:
                    data = bytes(r.content)
                    if r.method == "text":
                        parts = [("body", None, data.decode("utf-8", "replace").strip())]
                    elif r.method == "docx":
                        heading = None
                        for kind, t in docx_parts(data):
                            heading = t if kind == "heading" else heading
                            parts.append(("table" if kind == "table" else "body", heading, t))
                    elif r.method == "xlsx":
                        parts = [("sheet", n, t) for n, t in xlsx_parts(data)]
                    elif r.method == "rtf":
                        parts = [("body", None, rtf_text(data))]
                    elif r.method == "ocr" and ocr:
                        parts = [("image", None, ocr(data)[0].strip())]
                    elif r.method in ("manifest_only", "unsupported"):
                        status = r.method
                    parts = [p for p in parts if p[2]]
                    if status == "indexed" and not parts:
                        status = "no_text"
                except Exception as e:  # noqa: BLE001  one broken file must not stop the rest; its row says why
                    status, message, parts = "failed", f"{type(e).__name__}: {e}"[:500], []
                rows += [(r.file_id, r.relative_path, status, r.method, message, i, *p) for i, p in enumerate(parts)] or [(r.file_id, r.relative_path, status, r.method, message, None, None, None, None)]
            out = pd.DataFrame(rows, columns=["file_id", "relative_path", "status", "method", "message", "ordinal", "source_type", "section", "text"])
            yield out.astype({"ordinal": "Int64"})

    x = files.select("file_id", "relative_path", method(F.col("extension")).alias("method"), "content")
    return x.mapInPandas(run, "file_id string, relative_path string, status string, method string, message string, ordinal long, source_type string, section string, text string")


# Answers of OCR models that say that there is no text.
CANNED = (
    r"\bno\s+(visible|readable|recognizable)\s+text\b",
    r"\b(there is|i can(not|'t))\s+(no\s+)?(visible\s+)?text\b",
    r"\bтекст\s+(не\s+виден|не\s+обнаружен|отсутствует)\b",
)
DIAGRAM = ("схема", "diagram", "flowchart")


def ocr_rejected(text: Column, source_type: Column, provider: Column) -> Column:
    """Why an OCR text is not admitted, or null: a canned answer, or an embedded picture with fewer than 25 words."""
    body = F.trim(text)
    canned = F.lit(False)
    for pattern in CANNED:
        canned |= body.rlike(f"(?iU){pattern}")
    words = F.regexp_count(body, F.lit(r"[\p{L}\p{N}_]+"))
    short = (source_type == "embedded_image") & provider.startswith("dashscope") & (words < 25)
    return F.when(canned, "canned_no_text_response").when(short, F.concat(F.lit("decorative_or_too_short:"), words.cast("string"), F.lit("_tokens")))


def layout_route(text: Column, configured: Column, file_name: Column | None = None) -> Column:
    """table where two lines or more hold two pipes each; diagram where the text or file name says so, rotated if the page is; else what is configured, else flat_text."""
    pipes = F.size(F.filter(F.split(text, "\n"), lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2))
    said = F.lower(F.concat_ws(" ", file_name if file_name is not None else F.lit(""), text))
    drawn = F.lit(False)
    for word in DIAGRAM:
        drawn |= F.contains(said, F.lit(word))
    turned = F.when(configured == "rotated_page", "rotated_diagram").otherwise("diagram")
    return F.when(pipes >= 2, "table").when(drawn, turned).otherwise(F.coalesce(F.when(configured != "", configured), F.lit("flat_text")))


def recipe_hash(recipe: dict[str, Column]) -> Column:
    """What an OCR result depends on, as the hash of its canonical JSON: sorted keys, no blanks, nulls written."""
    one = lambda k, c: F.concat(F.lit(f'"{k}":'), F.coalesce(F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2), F.lit("null")))
    body = F.concat(F.lit("{"), F.concat_ws(",", *[one(k, recipe[k]) for k in sorted(recipe)]), F.lit("}"))
    return F.concat(F.lit("sha256:"), F.sha2(body, 256))


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object a line, keys sorted."""
    rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value")).write.text(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parsed lines; blank ones are skipped."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema).alias("r")).select("r.*")


def read_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their physical line numbers, errors) of an artefact of JSON lines: what can't be read is an error row and no exception.

    Blank lines count but give no rows. A missing path is one error. Artefacts of one run are read whole, file by file.
    """
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    errors = "path string, line long, message string"
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        rows = spark.createDataFrame([], f"line long, {schema}")
        return rows, spark.createDataFrame([(path, None, "required artifact missing")], errors)
    each = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "t")).where(F.trim("t") != "")
    parsed = each.select((F.col("n") + 1).cast("long").alias("line"), F.from_json("t", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    failed = parsed.where(bad).select(F.lit(path).alias("path"), "line", F.lit("not valid JSON").alias("message"))
    return parsed.where(~bad).select("line", "r.*").drop("_bad"), failed


# The fields of a catalogue's entry.
ENTRY = "relative_path string, status string, authoritative_rank int, version_group string, department string, document_type string, effective_from string, effective_to string, owner string, supersedes array<string>"


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """An authority catalogue of JSON: a list of entries, a mapping by path, or either below `documents`. The last entry of a path wins; other shapes are errors.

    A catalogue is kept by hand, so its file is read whole.
    """
    raw = spark.read.text(path, wholetext=True).select(F.trim("value").alias("w"))
    raw = raw.select(F.coalesce(F.when(F.col("w").startswith("{"), F.trim(F.get_json_object("w", "$.documents"))), F.col("w")).alias("v"))
    names = [c.split()[0] for c in ENTRY.split(", ")]
    entry = f"struct<{', '.join(c.replace(' ', ':', 1) for c in ENTRY.split(', '))}>"
    listed = raw.where(F.col("v").startswith("[")).select(F.posexplode(F.from_json("v", f"array<{entry}>")).alias("n", "e")).select("n", "e.*")
    named = raw.where(F.col("v").startswith("{")).select(F.posexplode(F.map_entries(F.from_json("v", f"map<string,{entry}>"))).alias("n", "e")).select("n", F.col("e.key").alias("relative_path"), *[f"e.value.{c}" for c in names[1:]])
    bad = raw.where(~F.col("v").rlike(r"^[\[{]")).select(F.raise_error(F.lit("a catalogue is a list or a mapping")).cast("string").alias("relative_path"), F.lit(0).alias("n"))
    x = listed.unionByName(named).unionByName(bad, allowMissingColumns=True).where(F.trim("relative_path") != "")
    return x.groupBy(F.trim("relative_path").alias("relative_path")).agg(F.max_by(F.struct(*names[1:]), "n").alias("r")).select("relative_path", "r.*")


def markdown_row(*columns: Column) -> Column:
    cell = lambda c: F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))
