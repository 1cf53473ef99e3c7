"""Generated, minified, vendored and data files among source files, by thresholds on layout statistics.

All of it is column expressions, so a file's text is read once, where it lies, and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds by language. A file is minified if its longest line and its mean line length are over the first two
#: and its share of white space is under the third; it is data if its share of digits within literals, or of long
#: encoded runs, or of lines that only hold literals, is over the last three.
LIMITS: dict[str, dict[str, float]] = {
    "py": {"longest": 400, "mean": 150, "white": 0.12, "numbers": 0.18, "runs": 0.35, "entries": 0.6},
    "ts": {"longest": 400, "mean": 150, "white": 0.14, "numbers": 0.18, "runs": 0.35, "entries": 0.6},
    "tsx": {"longest": 400, "mean": 150, "white": 0.14, "numbers": 0.18, "runs": 0.35, "entries": 0.6},
    "js": {"longest": 300, "mean": 120, "white": 0.14, "numbers": 0.18, "runs": 0.35, "entries": 0.6},
}

#: Lines of literals that a share of them is told from.
LEAST_LINES = 3

# How tools and copies name themselves in the comments around a file's statements, and places they are written to.
#: A statement about this very file. Statements about other files, or denials, have other wordings.
GENERATED = (
    r"(?im)(?:^[\s#/*!;<-]*(?:@generated\b|code generated\b|auto-?\s?generated\b|automatically generated\b"
    r"|(?:this|the) (?:file|module|code|source|class)\b[^\n]{0,40}\b(?:was|is|has been|were)\b[^\n]{0,30}\b(?:generated|produced|created|written)\b[^\n]{0,30}\b(?:automatically|by|from)\b"
    r"|(?:this|the) (?:file|module|code)\b[^\n]{0,40}\b(?:auto-?generated|machine[- ]generated)\b"
    r"|generated (?:by|from|with|using|automatically|on|at)\b|automatisch (?:erzeugt|generiert|erstellt)\b|g[ée]n[ée]r[ée] automatiquement\b|fichier g[ée]n[ée]r[ée]\b"
    r"|[\w.-]+ output\. source of truth\b)"
    r"|\bdo not (?:edit|modify)\b(?! the output)|\bmanual changes will be (?:lost|overwritten)\b|\bnicht von hand (?:bearbeiten|[äa]ndern)\b"
    r"|\bedits? (?:here )?(?:are|will be) overwritten\b)"
)
VENDORED = (
    r"(?im)(?:\bcopied (?:unchanged|verbatim|unmodified|as is)\b|\btaken over (?:verbatim|unchanged)\b|\bvendored (?:copy|from|by|file|version)\b|\bvendored:"
    r"|^[\s#/*!]*upstream: |\bpatch(?:es)? upstream\b|\blocal copy (?:so that|of)\b|@license\b|@preserve\b"
    r"|\breleased (?:under the [\w. -]{2,30}licen[sc]e )?by the [\w.@/-]+ (?:team|contributors|authors|project)\b"
    r"|^[\s#/*!]*[\w.@/-]+ v?\d+\.\d+[\w.-]* ?\| ?\(c\)|\(c\) [\w.@/-]+ contributors \|"
    r"|^/\*! [\w.@/-]+ v?\d+\.\d+)"
)
#: Denials and remarks that hold words of the above.
DENIED = r"(?i)(?:\bnot (?:auto-?)?generated\b|\bkept by hand\b|\bnot vendored\b|\bno longer generated\b|\bnot minified\b)"
GENERATED_PLACE = (
    r"(?i)(?:(?:^|/)(?:gen|generated|autogen|auto_generated|__generated__|generated[-_]sources)/"
    r"|(?:_pb2|_pb2_grpc|\.gen|_gen|\.generated|_generated|\.pb|\.g|\.designer)\.[a-z]+$)"
)
#: A package's folder within a folder of packages; a folder of packages alone doesn't make a case.
VENDORED_PLACE = r"(?i)(?:^|/)(?:vendor|_vendor|third[-_]party|thirdparty|3rdparty|external|extern|deps|node_modules|bower_components|site-packages|js/lib)/[^/]+/[^/]+$"
MINIFIED_PLACE = r"(?i)[.-]min\.js$"

#: The comments before the first statement: line comments, block comments and strings that stand alone.
_LEADING = r"\A(?:\x{feff}|#![^\n]*\n|\s|(?:#|//)[^\n]*(?:\n|\z)|/\*(?s:.*?)\*/|\"\"\"(?s:.*?)\"\"\"|'''(?s:.*?)'''|<!--(?s:.*?)-->|[\"']use strict[\"'];?)*+"

#: The comments after the last statement, from the start of a line.
_TRAILING = r"(?:\n(?:(?:#|//)[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/)\s*)+\z"


def _share(pattern: str) -> Column:
    """Share of the text's characters that matches of `pattern` hold."""
    left = F.length(F.regexp_replace("text", pattern, ""))
    return (F.length("text") - left) / F.col("n")


def layout(documents: DataFrame) -> DataFrame:
    """Layout statistics of every source file with a text: one row per document.

    ``doc_id, file_path, ending, n, lines, longest, mean, white, alnum, numbers, runs, entries,
    literal_lines, said``; shares are
    of the text's characters, `entries` of its lines that aren't blank. An empty text has zeros everywhere.
    """
    ending = F.regexp_extract("file_path", r"\.(py|tsx?|js)$", 1)
    files = (
        documents.where((ending != "") & F.col("text").isNotNull())
        .select("doc_id", "file_path", ending.alias("ending"), F.regexp_replace("text", r"\r\n?", "\n").alias("text"))
        .withColumn("n", F.greatest(F.length("text"), F.lit(1)))
        .withColumn("rows", F.split("text", "\n"))
    )
    filled = F.filter("rows", lambda r: F.trim(r) != "")
    entry = F.filter(
        "rows", lambda r: r.rlike(r"^\s*(?:[\"'][^\"']*[\"']\s*:\s*)?[\[({]*\s*(?:[-+]?[\d.][\w.+-]*|[\"'][^\"']*[\"'])(?:\s*[,:]\s*[\[({]*(?:[-+]?[\d.][\w.+-]*|[\"'][^\"']*[\"']|null|None|true|false|True|False))*\s*[\])}]*\s*,?\s*\+?\s*$")
    )
    return files.select(
        "doc_id",
        "file_path",
        "ending",
        "n",
        F.size("rows").alias("lines"),
        F.array_max(F.transform("rows", F.length)).alias("longest"),
        (F.col("n") / F.size("rows")).alias("mean"),
        _share(r"\s+").alias("white"),
        _share(r"[\p{L}\p{N}]+").alias("alnum"),
        _share(r"(?<![\w.])[-+]?(?:0x[0-9a-fA-F]+|\d[\d_.]*)(?!\w)").alias("numbers"),
        _share(r"[A-Za-z0-9+/=_-]{48,}|(?:\\x[0-9a-fA-F]{2}){12,}").alias("runs"),
        F.when(F.size(filled) > 0, F.size(entry) / F.size(filled)).otherwise(0.0).alias("entries"),
        F.size(entry).alias("literal_lines"),
        F.concat_ws("\n", F.regexp_extract("text", _LEADING, 0), F.regexp_extract("text", _TRAILING, 0)).alias("said"),
    )


def _limit(name: str) -> Column:
    chosen = F.lit(None).cast("double")
    for ending, limits in LIMITS.items():
        chosen = F.when(F.col("ending") == ending, F.lit(float(limits[name]))).otherwise(chosen)
    return chosen


def not_handwritten(documents: DataFrame) -> DataFrame:
    """Source files that aren't written by hand, each with the reason: ``doc_id, reason``.

    `reason` is ``minified``, ``data``, ``generated`` or ``vendored``, the first that holds. A statement counts in the
    comments before the first and after the last statement of the file; ignored folders and remarks elsewhere don't make a case. Null
    texts and files that aren't source files by their ending give no rows; a blank text counts by its place only.
    Copies of a document count each on their own.
    """
    said = lambda pattern: F.col("said").rlike(pattern)
    open_to = ~said(DENIED)
    minified = (
        (F.col("longest") > _limit("longest")) & (F.col("mean") > _limit("mean")) & (F.col("white") < _limit("white"))
    ) | F.col("file_path").rlike(MINIFIED_PLACE)
    data = (F.col("numbers") > _limit("numbers")) | (F.col("runs") > _limit("runs")) | (
        (F.col("entries") > _limit("entries")) & (F.col("literal_lines") >= LEAST_LINES)
    )
    generated = (said(GENERATED) & open_to) | F.col("file_path").rlike(GENERATED_PLACE)
    vendored = (said(VENDORED) & open_to) | F.col("file_path").rlike(VENDORED_PLACE)
    reason = (
        F.when(minified, "minified").when(data, "data").when(generated, "generated").when(vendored, "vendored")
    )
    return layout(documents).select("doc_id", reason.alias("reason")).where(F.col("reason").isNotNull())


def handwritten_rates(documents: DataFrame) -> DataFrame:
    """Files, and files not written by hand, per graph, ending and reason."""
    ending = F.regexp_extract("file_path", r"\.(py|tsx?|js)$", 1)
    files = documents.where((ending != "") & F.col("text").isNotNull())
    rows = files.select("doc_id", "graph_id", ending.alias("ending")).join(not_handwritten(documents), "doc_id", "left")
    return rows.groupBy("graph_id", "ending", F.coalesce("reason", F.lit("by hand")).alias("reason")).agg(
        F.count(F.lit(1)).alias("files")
    )
