"""Display labels, redaction and source naming as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text patterns and replacement words.
OSC_SEQUENCE = "\\x1b\\][^\\x07]*(?:\\x07|\\x1b\\\\)"
CSI_SEQUENCE = "\\x1b\\[[0-?]*[ -/]*[@-~]"
CONTROL_RUN = "[\\x00-\\x1f\\x7f-\\u009f]+"
# White space as browsers know it, ASCII and Unicode.
WHITE_SPACE = (
    " \t\n\r\f\x0b\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# The same characters inside a class of a pattern; ranges are faster to match.
IN_CLASS = "\\x09-\\x0d\\x20\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACES = f"[{IN_CLASS}]+"
USER_PATH = f"/Users/[^{IN_CLASS}\"'`]+"
TEMP_PATH = f"/(?:private/)?tmp/[^{IN_CLASS}\"'`]+"
SECRET_TEXT = (
    "\\b(?:sk-[A-Za-z0-9_-]{16,}|lin_api_[A-Za-z0-9_-]{12,}|gh[pousr]_[A-Za-z0-9_-]{16,})\\b"
)
LOCAL_PATH = "[local path]"
TEMPORARY_PATH = "[temporary path]"
REDACTED_SECRET = "[redacted credential-like text]"
DELEGATION_MARK = "<codex_delegation>"
WORKTREE_PATH = "/\\.codex/worktrees/[^/]+/([^/]+)$"
UPPER_CASE_TYPES = ["api", "cli", "sdk", "ui"]
UNLABELLED = "Unlabelled activity"
OTHER_ACTIVITY = "Other activity"
UNKNOWN_PROJECT = "Unknown project"



def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _present(c: Column) -> Column:
    """The value unless it is null or empty."""
    return F.nullif(c, F.lit(""))


def strip_control(c: Column) -> Column:
    """Remove terminal escape sequences; a run of control characters becomes one space."""
    out = F.regexp_replace(_text(c), OSC_SEQUENCE, "")
    out = F.regexp_replace(out, CSI_SEQUENCE, "")
    return F.regexp_replace(out, CONTROL_RUN, " ")


def clean_label(c: Column, fallback: str) -> Column:
    return F.coalesce(
        _present(_trim(F.regexp_replace(strip_control(c), SPACES, " "))), F.lit(fallback)
    )


def short_label(c: Column) -> Column:
    """A cleaned label; past 30 characters, its two ends around an ellipsis."""
    label = clean_label(c, UNLABELLED)
    cut = F.concat(F.substring(label, 1, 14), F.lit("…"), F.right(label, F.lit(13)))
    return F.when(F.length(label) <= 30, label).otherwise(cut)


def _base_name(c: Column) -> Column:
    """Last path segment; trailing slashes do not count."""
    return F.substring_index(F.rtrim(c, F.lit("/")), "/", -1)


def safe_base_name(c: Column, fallback: str = "local path") -> Column:
    name = _base_name(F.translate(_text(c), "\\", "/"))
    label = _trim(F.regexp_replace(strip_control(name), SPACES, " "))
    return F.when(label.isin("", ".", ".."), F.lit(fallback)).otherwise(label)


# An absolute path: POSIX, UNC in either slash, or a drive letter. A POSIX path may not start
# with two slashes, so the authority part of a URL is left alone.
_QUOTED = {
    q: (
        f"{q}(?:/(?:[^/\"'\\r\\n][^\"'\\r\\n]*)?|(?://|\\\\\\\\)[^\"'\\r\\n]+"
        f"|[A-Za-z]:[\\\\/][^\"'\\r\\n]*){q}"
    )
    for q in ("'", '"')
}
# Fixed value: the characters that end a bare path, in their published order.
_STOP = IN_CLASS + "\"'`)\\]},;"
# The pattern starts at the path itself and looks back for what opens one: few places have to be tried.
_BARE = (
    f"(?<![^{IN_CLASS}(\\[{{=])"
    f"(?:(?://|\\\\\\\\|[A-Za-z]:[\\\\/])[^{_STOP}]+|/[^/{_STOP}][^{_STOP}]*)"
)


def redact_paths(c: Column, paths: Iterable[str] = (), home_dirs: Iterable[str] = ()) -> Column:
    """Hide local paths: known ones by base name, private roots and any other absolute path."""
    known = {p for p in paths if p}
    known = {p for p in known if p.startswith(("/", "\\\\")) or p[1:3] in (":\\", ":/")}
    roots = {p for p in home_dirs if p}
    out = _text(c)
    for path in sorted((known | roots) - {"/"}, key=lambda p: (-len(p), p)):
        word = safe_base_name(F.lit(path)) if path in known else F.lit(LOCAL_PATH)
        out = F.replace(out, F.lit(path), word)
    for quote, pattern in _QUOTED.items():
        out = F.regexp_replace(out, pattern, f"{quote}{LOCAL_PATH}{quote}")
    return F.regexp_replace(out, _BARE, LOCAL_PATH)


def usage_type_label(c: Column) -> Column:
    """`tool_call` → `Tool Call`; short interface names in capitals."""
    raw = F.coalesce(_present(c), F.lit("unknown"))
    words = F.filter(F.split(_trim(F.regexp_replace(raw, "[_-]+", " ")), SPACES), lambda w: w != "")

    def title(w: Column) -> Column:
        low = F.lower(w)
        cap = F.concat(F.upper(F.substring(low, 1, 1)), F.substr(low, F.lit(2)))
        return F.when(low.isin(UPPER_CASE_TYPES), F.upper(low)).otherwise(cap)

    joined = F.array_join(F.transform(words, title), " ")
    return F.coalesce(_present(joined), F.lit("Unknown"))


def usage_type_key(c: Column) -> Column:
    low = F.lower(_trim(F.coalesce(_present(c), F.lit("unknown"))))
    return F.coalesce(_present(low), F.lit("unknown"))


def clean_remote(c: Column) -> Column:
    """A repository address as `host/path`, without credentials or the `.git` ending."""
    remote = _trim(c)
    scp_host = F.regexp_extract(remote, r"^[^@]+@([^:]+):(.+)$", 1)
    scp_path = F.regexp_extract(remote, r"^[^@]+@([^:]+):(.+)$", 2)
    bare_path = F.regexp_replace(scp_path, r"(?i)\.git$", "")
    host = F.lower(F.try_parse_url(remote, F.lit("HOST")))
    path = F.regexp_replace(
        F.regexp_replace(_text(F.try_parse_url(remote, F.lit("PATH"))), "^/+", ""),
        r"(?i)\.git$", "",
    )
    from_url = F.when(path != "", F.concat_ws("/", host, path)).otherwise(host)
    # A host alias without user reads as a scheme: nothing but the path is left.
    alias = remote.rlike(r"^(?!(?i:https?|ftp|wss?|file):)[A-Za-z][A-Za-z0-9+.-]*:[^/]")
    alias_path = F.regexp_replace(
        F.regexp_replace(remote, r"^[^:]+:|[?#].*$", ""), r"(?i)\.git$", "")
    stripped = F.regexp_replace(remote, "//[^/@]+@", "//")
    rest = F.regexp_replace(stripped, r"(?i)\.git$", "")
    return (
        F.when(_present(c).isNull(), F.lit(None).cast("string"))
        .when(scp_host != "", F.concat_ws("/", scp_host, bare_path))
        .when(alias, F.concat(F.lit("/"), alias_path))
        .when(host.isNotNull(), from_url)
        .otherwise(rest)
    )


def project_label(cwd: Column, git_origin: Column) -> Column:
    """Project name from the repository address, else from the working directory."""
    remote = _present(clean_remote(git_origin))
    parts = F.filter(F.split(remote, "/"), lambda p: p != "")
    n = F.size(parts)
    tail = F.array_join(F.slice(parts, F.greatest(n - 1, F.lit(1)), F.lit(2)), "/")
    path = F.rtrim(F.translate(_text(cwd), "\\", "/"), F.lit("/"))
    worktree = _present(F.regexp_extract(path, WORKTREE_PATH, 1))
    name = _base_name(path)
    from_path = F.coalesce(worktree, F.when(~name.isin("", ".", "/"), name))
    return F.coalesce(
        F.when(remote.isNotNull(), F.coalesce(_present(tail), F.lit(UNKNOWN_PROJECT))),
        from_path,
        F.lit(UNKNOWN_PROJECT),
    )


def source_labels(thread_source: Column, raw_source: Column) -> Column:
    """Where a thread came from, as struct<source, use_type>.

    ``raw_source`` is text: a plain word, or the JSON of a structured source.
    """
    text = _trim(raw_source)
    is_json = text.startswith("{")
    parsed = F.try_parse_json(F.when(is_json, text))
    subagent = F.try_variant_get(parsed, "$.subagent", "string")
    from_agent = parsed.isNotNull() & ~F.coalesce(subagent, F.lit("")).isin("", "false", "0")
    # A structured source that does parse is not a word.
    word = F.when(~is_json | parsed.isNull(), _present(text))
    kind = _present(thread_source)

    def pair(source: Column, use_type: Column) -> Column:
        return F.struct(source.alias("source"), use_type.alias("use_type"))

    def same(name: str) -> Column:
        return pair(F.lit(name), F.lit(name))

    return (
        F.when((kind == "subagent") | from_agent, same("subagent"))
        .when(kind == "automation", same("automation"))
        .when(kind == "realtime_voice", same("voice"))
        .when(word == "exec", same("cli"))
        .when(word == "vscode", pair(F.lit("desktop"), F.lit("interactive")))
        .when(
            word.isNotNull(),
            pair(word, F.coalesce(kind, F.lit("interactive"))),
        )
        .otherwise(pair(F.lit("unknown"), F.coalesce(kind, F.lit("unknown"))))
    )


def redact_title(c: Column) -> Column:
    """Hide user paths, temporary paths and credential-like text in a title."""
    out = F.regexp_replace(_text(c), USER_PATH, LOCAL_PATH)
    out = F.regexp_replace(out, TEMP_PATH, TEMPORARY_PATH)
    out = F.regexp_replace(out, SECRET_TEXT, REDACTED_SECRET)
    return F.regexp_replace(out, SPACES, " ")


def safe_title(
    session_title: Column,
    title: Column,
    name: Column,
    thread_source: Column,
    source: Column,
    agent_nickname: Column,
    thread_id: Column,
) -> Column:
    """Title of a thread, with a neutral one where the text is missing or not the user's."""
    text = _trim(_text(F.coalesce(_present(session_title), _present(title), _present(name))))
    subagent = F.coalesce(thread_source == "subagent", F.lit(False)) | F.coalesce(
        source.contains('"subagent"'), F.lit(False)
    )
    replaced = (
        (text == "") | text.contains(DELEGATION_MARK) | (subagent & (F.length(text) > 120))
    )
    neutral = (
        F.when(_present(agent_nickname).isNotNull(), F.concat(F.lit("Subagent · "), agent_nickname))
        .when(subagent, F.concat(F.lit("Subagent · "), F.substring(_text(thread_id), 1, 8)))
        .otherwise(F.lit("Untitled task"))
    )
    return F.when(replaced, neutral).otherwise(redact_title(text))
