"""Hashes, encodings, lines, paths, sizes and labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidefold.functions import hlc

#: Marker tokens, and the patterns that are left out by default.
OURS, BASE, SEPARATOR, THEIRS = "<<<<<<<", "|||||||", "=======", ">>>>>>>"
DEFAULT_EXCLUDES = (".git", ".git/**", ".trash/**", ".DS_Store", "**/.DS_Store")
BINARY_PROBE = 8192
PHASES = {"Rebuilding": ["Rebuilding"], "Pulling": ["Pulling", "Downloading"], "Pushing": ["Pushing", "Uploading"], "Merging": ["Merging"], "Applying": ["Applying"], "Reconciling": ["Reconciling"]}
LOCAL_ACTIONS = ("write_local", "write_merge", "move_local", "delete_local", "conflict", "delete_conflict", "binary_conflict")


def sha256(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def to_base64(x: Column) -> Column:
    return F.base64(x)


def from_base64(x: Column) -> Column:
    return F.unbase64(x)


def to_hex(x: Column) -> Column:
    return F.lower(F.hex(x))


def stable_id(*parts: Column) -> Column:
    """An id that is the same on every run: a hash of what it names, in the form of a UUID."""
    h = F.sha2(F.concat_ws("\u001f", *parts).cast("binary"), 256)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *cut)


def merge_id(content_hash: Column, parents: Column) -> Column:
    """The id of a merge node: one for a content and a set of parents, in whatever order."""
    return F.concat(F.lit("m-"), sha256(F.concat_ws("|", content_hash, F.array_join(F.sort_array(parents), "|"))))


def lines(text: Column) -> Column:
    """Lines after CRLF and CR become LF; an empty text is one empty line."""
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)


def is_binary(data: Column) -> Column:
    """Whether a NUL is among the first bytes."""
    return F.contains(F.substring(data.cast("binary"), 1, BINARY_PROBE), F.lit(bytearray(b"\0")))


def has_markers(text: Column) -> Column:
    """Some line opens a conflict and some line closes one, in any order."""
    starts = lambda token: F.exists(lines(text), lambda x: x.startswith(token))
    return starts(OURS) & starts(THEIRS)


def glob_pattern(glob: str) -> str:
    """The regular expression of a whole path: ** any text, * all but slashes, ? one such character."""
    out = ""
    for token in re.findall(r"\*\*|\*|\?|[^*?]+", glob):
        out += {"**": r"[\s\S]*", "*": "[^/]*", "?": "[^/]"}.get(token) or re.escape(token)
    return f"^{out}\\z"


def is_excluded(path: Column, state_dir: str, plugin_dir: str, config_dir: str, sync_config: bool = False, globs: tuple[str, ...] = DEFAULT_EXCLUDES) -> Column:
    """Whether a path takes no part: state, the plugin itself, workspace files, configuration unless wanted, globs."""
    under = lambda d: (path == d) | path.startswith(f"{d}/")
    rules = [under(state_dir), under(plugin_dir), path.isin(f"{config_dir}/workspace.json", f"{config_dir}/workspace-mobile.json")]
    if not sync_config:
        rules.append(under(config_dir))
    rules += [path.rlike(glob_pattern(g)) for g in globs]
    out = rules[0]
    for r in rules[1:]:
        out = out | r
    return out


def is_too_large(size: Column, limit_mb: float | None) -> Column:
    """No cap where the limit is unset or not positive."""
    return F.lit(False) if not limit_mb or limit_mb <= 0 else size > int(limit_mb * 1048576)


def affects_local(action: Column) -> Column:
    return action.isin(*LOCAL_ACTIONS)


def resolve_chunk(local: Column, remote: Column, pick: Column) -> Column:
    """The lines that a decision(kind, text) takes of a conflict; none: local."""
    return F.when(pick["kind"] == "remote", remote).when(pick["kind"] == "both", F.concat(local, remote)).when(pick["kind"] == "custom", pick["text"]).otherwise(local)


def head_provenance(version_id: Column) -> Column:
    """Who made a head and when; null for merge nodes."""
    return hlc.from_string(version_id)


def relative_time(at: Column, now: Column) -> Column:
    """just now, whole minutes, hours or days; empty for what is still to come."""
    s = F.floor((now - at) / 1000)
    ago = lambda span, unit: F.concat(F.floor(s / span).cast("string"), F.lit(f"{unit} ago"))
    return F.when(now < at, F.lit("")).when(s < 45, F.lit("just now")).when(s < 3600, ago(60, "m")).when(s < 86400, ago(3600, "h")).otherwise(ago(86400, "d"))


def byte_size(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1048576, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / 1048576))


def device_label(device: Column, own: str | None = None) -> Column:
    label = F.concat(F.lit("device "), F.substring(device, 1, 6))
    return label if own is None else F.when(device == own, F.lit("this device")).otherwise(label)


def coarse_phase(label: Column) -> Column:
    """The phase of a round that a detailed label belongs to."""
    out = F.when(F.lit(False), "")
    for phase, starts in PHASES.items():
        for x in starts:
            out = out.when(label.startswith(x), f"{phase}\u2026")
    return out.otherwise("Syncing\u2026")


def pick_summary(kept_deleted: Column, restored: Column, binary: Column) -> Column:
    """What a set of decisions leads to, in words."""
    many = lambda n, one: F.concat(n.cast("string"), F.lit(f" {one}"), F.when(n == 1, "").otherwise("s"))
    parts = F.array(F.when(kept_deleted > 0, F.concat(many(kept_deleted, "deletion"), F.lit(" kept"))), F.when(restored > 0, F.concat(restored.cast("string"), F.lit(" restored"))), F.when(binary > 0, F.concat(many(binary, "binary version"), F.lit(" chosen"))))
    return F.concat(F.array_join(parts, ", "), F.lit("."))


def op_label(kind: Column) -> Column:
    return F.when(kind == "create", "New").when(kind == "update", "Edited").when(kind == "delete", "Deleted").when(kind == "move", "Moved").otherwise(kind)


def error_of_status(status: Column) -> Column:
    """The kind of error of an HTTP status; null for success."""
    return F.when(status.between(200, 299), F.lit(None).cast("string")).when(status.isin(401, 403), "auth").when(status == 404, "not_found").when(status == 409, "stale_cursor").when(status == 413, "too_large").otherwise("server")


def error_class(kind: Column) -> Column:
    """Whether an error asks for new settings or is the link's."""
    return F.when(kind.isin("auth", "not_found", "key_mismatch", "decrypt"), "setup").when(kind.isin("network", "timeout"), "link").otherwise("other")


def gc_due(last: Column, now: Column, interval: int) -> Column:
    """A first run only seeds; a clock that went back is due."""
    return F.when(last.isNull(), False).otherwise((now - last >= interval) | (now < last))


def missing_fields(**settings: Column) -> Column:
    """Names of the settings that are null or blank."""
    named = [F.when(F.coalesce(F.trim(x), F.lit("")) == "", F.lit(k)) for k, x in settings.items()]
    return F.filter(F.array(*named), lambda x: x.isNotNull())


def json_or_default(text: Column, schema: str, **defaults: object) -> Column:
    """A struct of a JSON text; a field that is absent or of a wrong type gets its default."""
    parsed = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    return F.struct(*(F.coalesce(parsed[k], F.lit(v)).alias(k) for k, v in defaults.items()))
