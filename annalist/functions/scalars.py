"""Scalar transformations of the history store, as functions from Column to Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_A_Z, _a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _A_Z, _a_z)


def lower_a_z(text: str) -> str:
    return text.translate(str.maketrans(_A_Z, _a_z))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (Spark's trim takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def non_empty(c: Column) -> Column:
    """The stripped string, or null if nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def prompt_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def batch_id(machine: Column, from_history: Column, to_history: Column, from_rowid: Column, to_rowid: Column, count: Column) -> Column:
    parts = [x.cast("string") for x in (machine, from_history, to_history, from_rowid, to_rowid, count)]
    return F.concat(F.lit("b_"), prompt_hash(F.concat_ws(":", *parts)))


def tag_name(c: Column) -> Column:
    """Stripped, runs of white space as one space, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def home_as_tilde(c: Column) -> Column:
    """The user's name in home paths as ~; a name ends at the next separator."""
    return F.regexp_replace(c, r"(?i)(/users/|/home/)[^/]+|(\\users\\)[^\\]+", "$1$2~")


def iso_time(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_offset_time(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ssxxx")


def minute(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm")


def day(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def millis_of_iso(c: Column) -> Column:
    """Epoch milliseconds of an RFC 3339 time; null without an offset, or if it isn't one."""
    shaped = c.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$")
    return F.when(shaped, F.unix_millis(F.try_to_timestamp(F.regexp_replace(c, r"(\.\d{6})\d+", "$1"))))


def millis_of_date(c: Column) -> Column:
    """UTC midnight of yyyy-mm-dd in epoch milliseconds."""
    return F.when(c.rlike(r"^\d{4}-\d\d-\d\d$"), F.unix_millis(F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))))


def shell_quoted(c: Column) -> Column:
    return F.when(c.rlike(r"^[A-Za-z0-9_./-]+$"), c).otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\\''")), F.lit("'")))


def resume_command(source: Column, session_id: Column, project: Column) -> Column:
    """How to go on with a session in its own tool; null where the tool can't."""
    verb = F.when(source == "claude", F.lit("claude --resume ")).when(source == "codex", F.lit("codex resume ")).when(source == "cursor", F.lit("cursor-agent --resume=")).when(source == "grok", F.lit("grok resume "))
    folder = F.when(project.isNotNull() & (source != "codex"), F.concat(F.lit("cd "), shell_quoted(project), F.lit(" && "))).otherwise(F.lit(""))
    return F.concat(folder, verb, shell_quoted(session_id))


def cursor_project(c: Column) -> Column:
    return F.concat(F.lit("/"), F.replace(c, F.lit("-"), F.lit("/")))


def percent_decoded(c: Column) -> Column:
    """%XX decoded byte by byte; what isn't well formed stays; null if the bytes aren't UTF-8, or if empty."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)((?:%[0-9A-Fa-f]{2})+|[^%]+|%)"), F.lit(1))
    decoded = F.transform(parts, lambda x: F.when(x.rlike("^%[0-9A-Fa-f]{2}"), F.unhex(F.replace(x, F.lit("%"), F.lit("")))).otherwise(F.encode(x, "UTF-8")))
    whole = F.aggregate(decoded, F.lit("").cast("binary"), lambda a, x: F.concat(a, x))
    return F.nullif(F.try_validate_utf8(whole.cast("string")), F.lit(""))


def without_query_tag(c: Column) -> Column:
    text = strip(c)
    inside = F.startswith(text, F.lit("<user_query>")) & F.endswith(text, F.lit("</user_query>"))
    return F.when(inside, strip(F.substr(text, F.lit(13), F.length(text) - 25))).otherwise(text)


def preview(c: Column, most: int = 120) -> Column:
    line = F.regexp_replace(c, r"[\r\n]", " ")
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("..."))).otherwise(line)


def packed(c: Column, tokens: int) -> Column:
    """Four characters a token; measured in bytes, cut in characters."""
    most = 4 * tokens
    return F.when(F.octet_length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def without_credentials(url: Column) -> Column:
    return F.regexp_replace(url, r"^(.*?://)[^/@]*@", "$1")


def tool_target(name: Column, args: Column) -> Column:
    """What a tool call is about: the first of its usual arguments that it has."""

    def first(*keys):
        return F.coalesce(*(F.get_json_object(args, f"$.{k}") for k in keys))

    return (  # fixed values: the tools' names and their arguments, in this order
        F.when(name.isin("Read", "Edit", "Write", "NotebookEdit"), first("file_path", "path", "notebook_path"))
        .when(name == "Bash", first("command"))
        .when(name.isin("Grep", "Glob"), first("pattern"))
        .otherwise(first("file_path", "path", "url", "command"))
    )


def tool_text(name: Column, target: Column, args: Column) -> Column:
    return F.concat_ws(" ", name, F.coalesce(F.nullif(target, F.lit("")), args))


def is_edit_tool(name: Column) -> Column:
    return name.isin("Edit", "Write", "NotebookEdit")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once a row; in an expression that names it often Spark may compute it each time."""
    return F.element_at(F.transform(F.array(value), body), 1)


def patch_counts(patch: Column) -> Column:
    """struct(added, removed) of a unified diff's lines; file headers don't count."""

    def count(lines, sign):
        return F.size(F.filter(lines, lambda x: F.startswith(x, F.lit(sign)) & ~F.startswith(x, F.lit(sign * 3)))).cast("long")

    return bound(F.split(F.coalesce(patch, F.lit("")), "\n"), lambda lines: F.struct(count(lines, "+").alias("added"), count(lines, "-").alias("removed")))


def joined_fields(*labelled: tuple[str, Column]) -> Column:
    """'Label: value' lines of the values that are there."""
    return F.concat_ws("\n", *(F.when(non_empty(c).isNotNull(), F.concat(F.lit(f"{label}: "), non_empty(c))) for label, c in labelled))


def paths_overlap(a: Column, b: Column) -> Column:
    """Equal, or one ends with the other after a slash; slashes at the ends don't count, an empty path overlaps with none."""
    x, y = (F.trim(F.replace(c, F.lit("\\"), F.lit("/")), F.lit("/")) for c in (a, b))
    return (x != "") & (y != "") & ((x == y) | F.endswith(x, F.concat(F.lit("/"), y)) | F.endswith(y, F.concat(F.lit("/"), x)))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.trim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/")), "/"), -1)


def within(path: Column, scope: Column | str) -> Column:
    """Equal to the scope or below it; '/' holds every absolute path."""
    scope = F.lit(scope) if isinstance(scope, str) else scope
    base = F.regexp_replace(scope, r"[/\\]+$", "")
    low, under = ascii_lower(path), ascii_lower(base)
    below = F.startswith(low, F.concat(under, F.lit("/"))) | F.startswith(low, F.concat(under, F.lit("\\")))
    return F.when(base == "", F.startswith(path, F.lit("/"))).otherwise((path == base) | below)


def like_pattern(text: str) -> str:
    """A LIKE pattern around the user's text whose % and _ stay wildcards, for columns in ASCII lower case."""
    return "%" + lower_a_z(text).replace("\\", "\\\\") + "%"


def like_ascii(c: Column, text: str) -> Column:
    return ascii_lower(c).like(like_pattern(text))


def contains_ascii(c: Column, text: str) -> Column:
    """Substring in ASCII-insensitive case; % and _ are ordinary."""
    return F.contains(ascii_lower(c), F.lit(lower_a_z(text)))


#: What is taken for a secret.
SECRETS = (
    r"\brth_[a-z]+_[A-Za-z0-9._-]+",
    r"\bsk-[A-Za-z0-9._-]+",
    r"\bgh[pousr]_[A-Za-z0-9_]{20,}",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b",
)


def redacted(c: Column, most: int = 800) -> Column:
    """One line without secrets, cut with dots; null if nothing is left."""
    c = F.trim(F.regexp_replace(c, r"\s+", " "))
    for pattern in SECRETS:
        c = F.regexp_replace(c, pattern, "[REDACTED]")
    return F.nullif(F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c), F.lit(""))


def human_seconds(s: Column) -> Column:
    def told(unit, name):
        return F.concat(F.floor(s / unit).cast("string"), F.lit(name))

    return F.when(s < 90, told(1, "s")).when(s < 5400, told(60, "m")).when(s < 172_800, told(3600, "h")).otherwise(told(86_400, "d"))


def human_bytes(n: Column) -> Column:
    def scaled(power, name):
        return F.concat(F.format_string("%.1f", n / (1 << 10 * power)), F.lit(f" {name}"))

    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, scaled(1, "KB")).when(n < 1 << 30, scaled(2, "MB")).otherwise(scaled(3, "GB"))


def safe_cell(c: Column, most: int = 64) -> Column:
    plain = F.regexp_replace(c, r"\p{Cc}", "")
    return F.when(F.length(plain) > most, F.concat(F.substring(plain, 1, most), F.lit("…"))).otherwise(plain)


#: How prompts begin that a tool wrote, and the endings by which a path is known.
TOOL_PROMPTS = ("<system-reminder", "<command-", "Caveat:", "[Request interrupted")
FILE_ENDINGS = "ts|tsx|js|jsx|mjs|cjs|py|go|rs|rb|java|cs|cpp|cc|c|h|json|yaml|yml|toml|md|sh|sql|css|scss|html|svelte|vue"


def is_boilerplate(prompt: Column) -> Column:
    """Whether a prompt is a tool's own text."""
    text = F.regexp_replace(prompt, r"(?U)^\s+", "")
    found = F.lit(False)
    for start in TOOL_PROMPTS:
        found = found | F.startswith(text, F.lit(start))
    return found


def file_paths(text: Column, most: int = 20) -> Column:
    """The first distinct file paths that a text mentions."""
    # fixed value: how a path looks
    path = rf"(?m)(?:^|[\s,`'\"(])([~./][\w./-]*\.(?:{FILE_ENDINGS})|-?[\w/-]+\.(?:{FILE_ENDINGS}))\b"
    found = F.regexp_extract_all(text, F.lit(path), F.lit(1))
    return F.slice(F.array_distinct(F.filter(found, lambda x: (F.length(x) > 2) & (F.length(x) < 200))), 1, most)


def first_keys(m: Column, k: int) -> Column:
    return F.slice(F.array_sort(F.map_keys(m)), 1, k)


def cursor_text(m: Column, known: tuple[str, ...] = ("history_id", "trajectory_rowid"), most: int = 6) -> Column:
    """'key=value ...' of a map: known keys first, the others by name, `most` at most, then '(+n more)'; - if empty."""
    keys = F.map_keys(m)
    own = F.filter(F.array(*map(F.lit, known)), lambda x: F.array_contains(keys, x))
    ordered = F.concat(own, F.array_sort(F.array_except(keys, own)))
    parts = F.transform(F.slice(ordered, 1, most), lambda k: F.concat(safe_cell(k), F.lit("="), safe_cell(F.element_at(m, k).cast("string"))))
    more = F.when(F.size(ordered) > most, F.array(F.concat(F.lit("(+"), (F.size(ordered) - most).cast("string"), F.lit(" more)")))).otherwise(F.array().cast("array<string>"))
    return F.when(F.coalesce(F.size(m), F.lit(0)) < 1, "-").otherwise(F.array_join(F.concat(parts, more), " "))


def display_name(*names: Column) -> Column:
    """The first name that isn't empty: a machine's host name, its label, its id."""
    return F.coalesce(*(F.nullif(n, F.lit("")) for n in names))


def status_cell(status: Column) -> Column:
    return F.when(status.isin("stale", "missing"), F.upper(status)).otherwise(safe_cell(status))


def _cut_line(text: Column, most: int) -> Column:
    line = F.replace(text, F.lit("\n"), F.lit(" "))
    return F.when(F.length(text) > most, F.concat(F.substring(line, 1, most), F.lit("..."))).otherwise(line)


def entry_text(entry_id: Column, ms: Column, source: Column, project: Column, session_id: Column, prompt: Column, most: int = 300) -> Column:
    """An entry as three lines: number, minute, source and project; session; prompt cut to `most`."""
    place = F.when(F.coalesce(project, F.lit("")) != "", F.concat(F.lit("  ["), project, F.lit("]"))).otherwise("")
    head = F.concat(F.lit("#"), entry_id.cast("string"), F.lit("  "), minute(ms), F.lit("  ("), source, F.lit(")"), place)
    return F.concat_ws("\n", head, F.concat(F.lit("  session_id: "), F.coalesce(session_id, F.lit("(none)"))), F.concat(F.lit("  "), _cut_line(prompt, most)))


def trajectory_text_row(tid: Column, ms: Column, project: Column, persona: Column, title: Column, description: Column, decisions: Column, summary: Column, approach: Column, learnings: Column, confidence: Column, most: int = 500) -> Column:
    """A trajectory's lines, in one line and cut if longer than `most`; decisions: array of (question, chosen, reasoning, alternatives)."""

    def labelled(label, c):
        return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}: "), c))

    def told(d, i):
        others = F.when(F.size(d["alternatives"]) > 0, F.concat(F.lit(" alternatives: "), F.array_join(d["alternatives"], ", "))).otherwise("")
        return F.concat((i + 1).cast("string"), F.lit(". "), d["question"], F.lit("\n   chosen: "), d["chosen"], F.lit("\n   reasoning: "), d["reasoning"], others)

    listed = F.array_join(F.transform(decisions, told), "\n")
    retro = F.concat_ws("\n", labelled("summary", summary), labelled("approach", approach), labelled("learnings", F.array_join(learnings, "; ")), labelled("confidence", confidence.cast("string")))
    where = F.when(F.coalesce(project, F.lit("")) != "", F.concat(F.lit("  ["), project, F.lit("]"))).otherwise("")
    who = F.when(F.coalesce(persona, F.lit("")) != "", F.concat(F.lit("  persona: "), persona)).otherwise("")
    body = F.concat_ws(
        "\n", F.concat(F.lit("trajectory_id: "), tid), F.concat(minute(ms), where, who), F.concat(F.lit("task: "), F.coalesce(title, F.lit("(untitled task)"))), labelled("description", description),
        F.when(listed != "", F.concat(F.lit("decisions:\n"), listed)), F.when(retro != "", F.concat(F.lit("retrospective:\n"), retro)),
    )
    return F.when(F.length(body) > most, _cut_line(body, most)).otherwise(body)


def unfenced_json(c: Column) -> Column:
    """The JSON text inside a fenced block, or the text."""
    return strip(F.regexp_replace(strip(c), r"(?s)^```(?:json)?\s*|\s*```$", ""))
