"""Code-aware text functions: repairs of recognized code, panels, classification, structural scores."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quirewright.functions.text import split_lines, strip, unix_lines

# Tokens that recognizers run together, as prefix: suffixes.
MODULES = "requests os sys json re subprocess hashlib base64 datetime urllib socket struct threading".split()
MERGED = [
    *(("import", m) for m in MODULES),
    *(("from", m) for m in MODULES),
    *(("def", m) for m in "main run login exploit parse send recv encrypt decrypt encode decode build execute".split()),
    *(("class", m) for m in "Exploit Client Server Parser Config".split()),
    ("print", "("),
    *(("return", m) for m in "response result data value True False None".split()),
    *(("sudo", m) for m in "apt pip npm systemctl docker".split()),
    *(("curl", m) for m in "http -X -H -d".split()),
    ("wget", "http"), ("npm", "install"), ("pip", "install"), ("apt", "install"), ("apt", "update"), ("apt", "upgrade"),
    ("cd", "/"), ("ls", "-l"), ("ls", "-la"), ("cat", "/etc"), ("grep", "-r"), ("grep", "-i"), ("chmod", "+x"), ("chmod", "755"), ("chmod", "644"), ("mkdir", "-p"), ("rm", "-rf"),
    ("GET", "/api"), ("POST", "/api"), ("PUT", "/api"), ("DELETE", "/api"), ("Content-Type:", "application"), ("Authorization:", "Bearer"), ("User-Agent:", "Mozilla"),
    ("diff", "--git"), ("index", "0000000"),
]
# Full-width punctuation and its ASCII form, in order.
FULL_WIDTH = "，。：；！？（）［］｛｝＂＇＜＞＝＋－＊／＼＆｜＃％＠＄＾～｀"
ASCII_FORM = ",.:;!?()[]{}\"'<>=+-*/\\&|#%@$^~`"
# What marks text as code.
CODE_MARKS = (
    "import", "def ", "class ", "function", "var ", "let ", "const ", "printf", "echo ", "print", "return ", "if ", "for ", "while ", "GET ", "POST ", "HTTP/", "@@", "$ ", "> ",
    "Content-Type:", "Content-Length:", "Authorization:", "User-Agent:", "Accept:", "Host:", "Cookie:", "Set-Cookie:", "Location:", "Server:", "Date:", "Cache-Control:", "X-",
    ".yml", ".yaml", ".json", ".toml", ".ini", ".conf",
)
# Keywords that real code has.
KEYWORDS = sorted(set("""
import from def class return if else elif for while try except finally with as lambda yield raise pass break continue global nonlocal
assert del in is not and or None True False print self
echo export source alias function local readonly cd ls cat grep awk sed curl wget ssh sudo chmod chown mkdir rm cp mv touch exit
const let var async await new typeof instanceof this null undefined console
package func go chan select defer range map
fn mut pub struct enum impl trait use
public private protected static final void extends implements throws
GET POST PUT DELETE PATCH HEAD OPTIONS HTTP Host Content-Type Content-Length Authorization Cookie User-Agent Accept Set-Cookie Location Server Date
true false
""".split()))  # fmt: skip

SEGMENT = "array<struct<role:string,text:string,command:string>>"


# ---- repairs ----------------------------------------------------------------------------------------------------


def strip_line_numbers(text: Column) -> Column:
    """Without an editor's line numbers, if every non-blank line, two at least, begins with one; else as it is."""
    lines = F.split(text, "\n")
    full = F.filter(lines, lambda x: strip(x) != "")
    numbered = (F.size(full) >= 2) & F.forall(full, lambda x: x.rlike(r"(?U)^\s*\d+\s+"))
    bare = F.array_join(F.transform(lines, lambda x: F.when(strip(x) == "", x).otherwise(F.regexp_replace(x, r"(?U)^\s*\d+\s+", ""))), "\n")
    return F.when(numbered, bare).otherwise(text)


def split_merged(text: Column) -> Column:
    """Struct of the text with run-together keywords split, and the splits made.

    The rules apply one after the other; a guard of one pattern keeps texts without any of them out of the chain.
    """
    guard = r"(?<![A-Za-z0-9_])(?:" + "|".join(_quoted(a + b) for a, b in MERGED) + r")(?![A-Za-z0-9_])"

    @F.pandas_udf("text string, done array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import re

        rules = [(re.compile(r"(?<![A-Za-z0-9_])" + re.escape(a + b) + r"(?![A-Za-z0-9_])"), a + b, f"{a}(" if b == "(" else f"{a} {b}") for a, b in MERGED]
        for s in batches:
            texts, done = [], []
            for t in s:
                made = []
                for rule, old, new in rules if t else ():
                    if old in t:
                        t, n = rule.subn(lambda m, new=new: new, t)
                        if n:
                            made.append(f"split:{old}->{new}")
                texts.append(t)
                done.append(made)
            yield pd.DataFrame({"text": texts, "done": done})

    untouched = F.struct(text.alias("text"), F.array().cast("array<string>").alias("done"))
    return F.when(text.rlike(guard), run(text)).otherwise(untouched)


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|/" else c for c in s)


def looks_like_code(text: Column) -> Column:
    """Whether any sign of code stands in the text: a marker, three brackets or the like, or a key with a value."""
    marks = reduce(lambda a, b: a | b, [text.contains(m) for m in CODE_MARKS])
    brackets = F.length(text) - F.length(F.translate(text, "()[]{}=;:", "")) >= 3
    return (text != "") & (marks | brackets | text.rlike(r"(?mdU)^[A-Za-z][A-Za-z0-9\-]*\s*[:：=]\s*\S"))


def ascii_punctuation(text: Column) -> Column:
    """Full-width punctuation as ASCII, in text that looks like code only."""
    return F.when(looks_like_code(text), F.translate(text, FULL_WIDTH, ASCII_FORM)).otherwise(text)


def recover_indentation(text: Column) -> Column:
    """Indentation from colons and braces for lines that have none: a fold over lines, in Arrow batches."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(t):
            if not t:
                return t
            depth, out, changed = 0, [], False
            for line in t.split("\n"):
                body = line.lstrip()
                if not body or line[0] in " \t":
                    out.append(line if body else "")
                    continue
                if body[0] in "})]":
                    depth = max(0, depth - 4)
                changed |= depth > 0
                out.append(" " * depth + body)
                depth += 4 * (body[-1] in ":{")
            return "\n".join(out) if changed else t

        for s in batches:
            yield s.map(one)

    return run(text)


def post_process(raw: Column) -> Column:
    """Recognized text ready for selection: LF line ends, line numbers and trailing blanks gone, no blank edge lines."""
    text = strip_line_numbers(unix_lines(raw))
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\n+|\n+$", "")


def looks_space_merged(text: Column) -> Column:
    """A word of more than 80 characters, or more than 60 characters without a single space."""
    return text.rlike(r"(?U)\S{81,}") | ((F.length(F.regexp_replace(text, r"(?U)\s", "")) > 60) & ~text.contains(" "))


# ---- panels: segments between starts, each start told by a line and its neighbour --------------------------------


def _segments(lines: Column, starts: Column, role: callable, command: callable | None = None) -> Column:
    """Segments of the lines that begin at the (1-based) ``starts``; ``role`` and ``command`` get the first line and its index."""
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(lines) + 1))
    return F.transform(
        F.arrays_zip(starts.alias("s"), ends.alias("e")),
        lambda z: F.struct(
            role(F.element_at(lines, z["s"]), z["s"]).alias("role"),
            F.array_join(F.slice(lines, z["s"], z["e"] - z["s"]), "\n").alias("text"),
            (command(z["s"]) if command else F.lit(None).cast("string")).alias("command"),
        ),
    )


def _indexes(lines: Column, start: callable) -> Column:
    """Indexes i (1-based) with ``start(line, previous line, i)``."""
    flags = F.transform(lines, lambda x, i: F.when(start(x, F.when(i > 0, F.get(lines, i - 1)), i), i + 1))
    return F.filter(flags, lambda x: x.isNotNull())


PROMPT = r"(?U)^\s*(?:\$|>>|>)\s?"


def terminal_panels(text: Column) -> Column:
    """Commands (lines after a prompt, without it) and outputs, each output with the command before it."""
    lines = F.split(text, "\n")
    is_prompt = lambda x: x.rlike(PROMPT)
    starts = _indexes(lines, lambda x, prev, i: is_prompt(x) | (i == 0) | is_prompt(prev))
    made = _segments(lines, starts, lambda x, i: F.when(is_prompt(x), "command").otherwise("output"), lambda s: F.when(s > 1, F.get(lines, s - 2)))
    bare = F.transform(
        made,
        lambda z: F.struct(
            z["role"].alias("role"),
            F.when(z["role"] == "command", F.regexp_replace(z["text"], PROMPT, "")).otherwise(z["text"]).alias("text"),
            F.when(z["role"] == "output", F.regexp_replace(z["command"], PROMPT, "")).alias("command"),
        ),
    )
    return F.when(text == "", F.array().cast(SEGMENT)).otherwise(bare)


DIFF_FILE, DIFF_HUNK = r"^(diff --git|index |---|\+\+\+) ", r"^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@"


def diff_panels(text: Column) -> Column:
    """File headers (each line one), hunk headers and hunk contents of a diff."""
    lines = F.split(text, "\n")
    file, hunk = (lambda x: x.rlike(DIFF_FILE)), (lambda x: x.rlike(DIFF_HUNK))
    starts = _indexes(lines, lambda x, prev, i: file(x) | hunk(x) | (i == 0) | hunk(prev))
    made = _segments(lines, starts, lambda x, i: F.when(file(x), "file_header").when(hunk(x), "hunk_header").otherwise("hunk_content"))
    return F.when(text == "", F.array().cast(SEGMENT)).otherwise(made)


HTTP_REQUEST, HTTP_STATUS, HTTP_HEADER = r"(?U)^\s*(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS) [^ ]+ HTTP/\d", r"(?U)^\s*HTTP/\d[\d.]*\s+\d{3}", r"(?U)^[A-Za-z][A-Za-z0-9\-]*:\s+.+$"


def http_panels(text: Column) -> Column:
    """Start lines, headers and bodies of the requests and responses of a transcript."""
    lines = F.split(text, "\n")
    begins = lambda x: x.rlike(HTTP_REQUEST) | x.rlike(HTTP_STATUS)
    starts = _indexes(lines, lambda x, prev, i: begins(x) | (i == 0))
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(lines) + 1))

    def first(array: Column, test: callable) -> Column:
        """0-based place of the first element that meets the test, the size if none does."""
        at = F.array_position(F.transform(array, lambda x: F.when(test(x), 1).otherwise(0)), 1)
        return F.when(at == 0, F.size(array)).otherwise(at - 1).cast("int")

    def parts(block: Column) -> Column:
        kind = F.when(F.element_at(block, 1).rlike(HTTP_REQUEST), "request").when(F.element_at(block, 1).rlike(HTTP_STATUS), "status").otherwise("none")
        name = F.when(kind == "request", "request").otherwise("response")
        rest = F.slice(block, 2, F.size(block))
        head = first(rest, lambda x: (strip(x) == "") | x.rlike(HTTP_HEADER))
        after = F.slice(rest, head + 1, F.size(block))
        headers = first(after, lambda x: ~x.rlike(HTTP_HEADER))
        tail = F.slice(after, headers + 1, F.size(block))
        body = F.when(strip(F.element_at(tail, 1)) == "", F.slice(tail, 2, F.size(block))).otherwise(tail)
        join = lambda a: F.array_join(a, "\n")
        no = F.lit(None).cast("string").alias("command")
        whole = F.array(
            F.struct(F.when(kind == "request", "request_line").otherwise("status_line").alias("role"), join(F.concat(F.slice(block, 1, 1), F.slice(rest, 1, head))).alias("text"), no),
            F.struct(F.concat(name, F.lit("_header")).alias("role"), F.when(headers > 0, join(F.slice(after, 1, headers))).alias("text"), no),
            F.struct(F.concat(name, F.lit("_body")).alias("role"), F.when(F.size(tail) > 0, F.when(F.size(body) > 0, join(body))).alias("text"), no),
        )
        lead = F.array(F.struct(F.lit("response_body").alias("role"), join(block).alias("text"), no))
        return F.filter(F.when(kind == "none", lead).otherwise(whole), lambda z: z["text"].isNotNull())

    blocks = F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda z: F.slice(lines, z["s"], z["e"] - z["s"]))
    return F.when(text == "", F.array().cast(SEGMENT)).otherwise(F.flatten(F.transform(blocks, parts)))


def panels(text: Column, visual_type: Column) -> Column:
    """The segments of a terminal, HTTP or diff visual; none for other types."""
    return (
        F.when(visual_type == "terminal", terminal_panels(text))
        .when(visual_type == "http", http_panels(text))
        .when(visual_type == "diff", diff_panels(text))
        .otherwise(F.array().cast(SEGMENT))
    )


# ---- classification ---------------------------------------------------------------------------------------------

# Patterns by which text is told apart, in the order in which they are tried.
HTTP = r"(?mdU)^\s*(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|TRACE|CONNECT)\s+\S+\s+HTTP/\d"
DIFF = r"(?mdU)^\s*(\+\+\+|---|@@|\+[^+]|-[^-])"
TRACEBACK = r"(?U)\b(Traceback|Exception|Error:|File \"[^\"]+\", line \d+)"
LOG = r"(?mdU)^\s*\d{4}-\d{2}-\d{2}[\sT]\d{2}:\d{2}:\d{2}|^\s*(DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL)\b"
SHELL = r"(?mdU)^\s*[$>]\s"
INI = r"(?mdU)^\s*\[[^\]]+\]\s*$"
JSON = r"(?mdU)^\s*[{\[]"
YAML = r"(?mdU)^\s*[\w.\-]+\s*:\s"


def classify_text(text: Column, fallback: Column | str = "code") -> Column:
    """Visual type by what the text looks like; ``fallback`` where nothing tells."""
    default = F.lit(fallback) if isinstance(fallback, str) else fallback
    json = text.rlike(JSON) & strip(text).rlike(r"[\]}]$")
    return (
        F.when(strip(text) == "", default)
        .when(text.rlike(HTTP), "http")
        .when(text.rlike(DIFF), "diff")
        .when(text.rlike(TRACEBACK), "stack_trace")
        .when(text.rlike(LOG), "log")
        .when(text.rlike(SHELL), "terminal")
        .when(text.rlike(INI) | json | (text.rlike(YAML) & ~text.contains("=")), "configuration")
        .otherwise(default)
    )


def classify_context(alt: Column, around: Column) -> Column:
    """Visual type by alternative text, then by keywords in the text around; ``code`` where nothing tells."""
    a, c = F.lower(F.coalesce(alt, F.lit(""))), F.lower(F.coalesce(around, F.lit("")))
    some = lambda col, *words: reduce(lambda x, y: x | y, [col.contains(w) for w in words])
    return (
        F.when(some(a, "logo", "icon", "avatar", "decorative", "sponsor"), "decorative")
        .when(some(a, "diagram", "architecture", "flowchart", "graph"), "diagram")
        .when(some(a, "screenshot of", "screenshot:", "ui ", "interface"), "ui_screenshot")
        .when(c.contains("http") & some(c, "request", "response", "burp"), "http")
        .when(some(c, "diff", "patch"), "diff")
        .when(some(c, "terminal", "shell", "console", "command line"), "terminal")
        .when(some(c, "traceback", "stack trace", "exception"), "stack_trace")
        .when(c.contains("log") & some(c, "server", "application", "error"), "log")
        .when(some(c, "config", "yaml", "ini"), "configuration")
        .when(c.contains("table"), "table")
        .otherwise("code")
    )


def detect_language(text: Column, visual_type: Column) -> Column:
    """Language by visual type, then by form; NULL where nothing tells."""
    json = text.rlike(JSON) & strip(text).rlike(r"[\]}]$")
    config = F.when(json, "json").when(text.rlike(INI), "ini").when(text.rlike(YAML), "yaml")
    return (
        F.when(visual_type.isin("http", "diff"), visual_type)
        .when(visual_type == "terminal", "bash")
        .when(visual_type.isin("log", "stack_trace"), "log")
        .when(visual_type == "configuration", config)
        .when(text.rlike(r"(?mdU)^\s*def\s+\w+\s*\(") | F.substring_index(text, "\n", 1).contains("import "), "python")
        .when(text.rlike(r"(?mdU)^\s*#include\s+[<\"]") | text.rlike(r"\bint\s+main\s*\("), "cpp")
        .when(text.rlike(r"(?mdU)^\s*(const|let|var|function)\s+"), "javascript")
        .when(text.rlike(r"(?mdU)^\s*(func|package)\s+"), "go")
        .when(text.rlike(r"(?mdU)^\s*(use\s+std|fn\s+|impl\s+|mod\s+)"), "rust")
    )


def code_like(text: Column) -> Column:
    """Struct (is_code, language): whether a page's text block is code, by the first sign that fits."""
    http = text.rlike(r"(?mdU)^\s*(GET|POST|PUT|DELETE|PATCH|HEAD) [^ ]+ HTTP/\d")
    diff = text.rlike(r"(?mdU)^(\+\+\+|---|@@)") & text.rlike(r"(?mdU)^[+-]")
    python = text.rlike(r"(?mdU)^\s*(def |class |import |from |    )")
    key = text.rlike(r"(?mdU)^\s*[\w\-.\s]+:\s") & ~text.contains("=")
    lang = F.when(http, "http").when(diff, "diff").when(text.rlike(SHELL), "bash").when(python, "python")
    blank = strip(text) == ""
    return F.struct((~blank & (lang.isNotNull() | key)).alias("is_code"), F.when(~blank, lang).alias("language"))


# ---- structural scores ------------------------------------------------------------------------------------------


def bracket_balance(text: Column) -> Column:
    """1 less the share of brackets without partner; 0.5 without brackets, 0 for empty text."""
    marks = F.regexp_extract_all(text, F.lit(r"([()\[\]{}])"), F.lit(1))

    def one(opener: str, closer: str) -> Column:
        seq = F.filter(marks, lambda x: x.isin(opener, closer))
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("bad"))
        step = lambda a, x: F.when(x == opener, F.struct((a["depth"] + 1).alias("depth"), a["bad"].alias("bad"))).otherwise(
            F.struct(F.greatest(a["depth"] - 1, F.lit(0)).alias("depth"), (a["bad"] + F.when(a["depth"] <= 0, 1).otherwise(0)).alias("bad"))
        )
        return F.aggregate(seq, start, step, lambda a: a["depth"] + a["bad"])

    bad = one("(", ")") + one("[", "]") + one("{", "}")
    return F.when(text == "", 0.0).when(F.size(marks) == 0, 0.5).otherwise(F.greatest(F.lit(0.0), 1 - bad / F.size(marks)))


def keyword_density(text: Column) -> Column:
    """Distinct keywords that stand as identifiers, a fifth each, 1 at most."""
    runs = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}\p{M}_]+)"), F.lit(1))
    words = F.filter(runs, lambda w: w.rlike("^[A-Za-z_][A-Za-z0-9_]*$"))
    hits = F.size(F.array_intersect(words, F.array(*[F.lit(k) for k in KEYWORDS])))
    return F.least(F.lit(1.0), hits / 5.0)


def line_length(text: Column) -> Column:
    """1 less the share of lines of more than 120 characters without a space."""
    lines = split_lines(text)
    bad = F.size(F.filter(lines, lambda x: (F.length(x) > 120) & ~x.contains(" ")))
    return F.when(F.size(lines) == 0, 0.0).otherwise(1 - bad / F.size(lines))


def space_ratio(text: Column) -> Column:
    """1 where spaces are 0.05 to 0.5 of the other characters, falling off on either side."""
    full = F.length(F.regexp_replace(text, r"(?U)\s", ""))
    ratio = (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))) / full
    return F.when(full == 0, 0.0).when(ratio.between(0.05, 0.5), 1.0).when(ratio < 0.05, ratio / 0.05).otherwise(F.greatest(F.lit(0.0), 1 - (ratio - 0.5) / 0.5))


def type_tokens(text: Column, visual_type: Column) -> Column:
    """How far the text has what its visual type should have."""
    return (
        F.when(text == "", 0.5)
        .when(visual_type == "http", F.when(text.rlike(r"HTTP/\d"), 1.0).otherwise(0.3))
        .when(visual_type == "diff", F.when(text.contains("@@") & (text.contains("+") | text.contains("-")), 1.0).otherwise(0.3))
        .when(visual_type == "terminal", F.when(text.rlike(SHELL), 1.0).otherwise(0.3))
        .when(visual_type == "code", F.when(text.rlike(r"(?mdU):\s*$|;\s*$"), 0.8).otherwise(0.5))
        .otherwise(0.5)
    )


def structural_score(text: Column, visual_type: Column) -> Column:
    """Weighted sum of the five scores; 0 for empty text."""
    total = 0.25 * bracket_balance(text) + 0.25 * keyword_density(text) + 0.15 * line_length(text) + 0.15 * space_ratio(text) + 0.20 * type_tokens(text, visual_type)
    return F.when(text == "", 0.0).otherwise(total)
