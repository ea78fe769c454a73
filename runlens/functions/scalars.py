"""Scalar building blocks. All of them are Column -> Column and stay inside whole-stage codegen."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import names


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def group_of(col: Column, pattern: str, idx: int = 1) -> Column:
    """First match's group, null (not '') when the pattern does not match."""
    return F.when(col.rlike(pattern), F.regexp_extract(col, pattern, idx))


def try_long(col: Column) -> Column:
    return col.try_cast("long")


def retval_int(col: Column | str) -> Column:
    """Integer literal in its own base (decimal, 0x, 0o, 0b); null for anything else, also for `012`."""
    raw = F.trim(_c(col))
    digits = F.substring(raw, 3, 64)
    return (F.when(raw.rlike("^[+-]?([1-9][0-9]*|0+)$"), try_long(raw))
            .when(raw.rlike("^0[xX][0-9a-fA-F]+$"), try_long(F.conv(digits, 16, 10)))
            .when(raw.rlike("^0[oO][0-7]+$"), try_long(F.conv(digits, 8, 10)))
            .when(raw.rlike("^0[bB][01]+$"), try_long(F.conv(digits, 2, 10))))


def call_path(call: Column, args: Column, path_calls: list[str]) -> Column:
    return F.when(call.isin(path_calls), group_of(args, r'"((?:[^"\\]|\\.)*)"'))


def call_fd(call: Column, args: Column, fd_calls: list[str]) -> Column:
    return F.when(call.isin(fd_calls), group_of(args, r"^\s*(-?\d+)").try_cast("int"))


def fd_or_first_arg(fd: Column | str, args: Column | str) -> Column:
    return F.coalesce(_c(fd), group_of(F.coalesce(_c(args), F.lit("")), r"^\s*(-?\d+)").try_cast("int"))


# How a call's arguments print a socket address.
_INET4 = r'inet_addr\("([^"]+)"\)'
_INET6 = r'inet_pton\(AF_INET6,\s*"([^"]+)"'
_BARE_ADDR = r'sin6?_addr=[^,}]*?"([0-9a-fA-F:.]+)"'
_SUN_PATH = r'sun_path="([^"]+)"'
_PORT = r"sin6?_port=htons\((\d+)\)"


def socket_address(args: Column | str) -> Column:
    """STRUCT(family, address, port) from a socket-call argument dump."""
    a = F.coalesce(_c(args), F.lit(""))
    family = F.coalesce(group_of(a, r"sa_family=(AF_\w+)"), F.lit("AF_?"))
    address = (F.when(family == "AF_INET", group_of(a, _INET4)).when(family == "AF_INET6", group_of(a, _INET6))
               .when(family == "AF_UNIX", group_of(a, _SUN_PATH)))
    port = F.when(family.isin("AF_INET", "AF_INET6"), group_of(a, _PORT).try_cast("int"))
    return F.struct(family.alias("family"), address.alias("address"), port.alias("port"))


def peer_key(args: Column | str) -> Column:
    """host:port, [v6]:port or unix:/path; null when the arguments name no peer."""
    a = _c(args)
    bare = group_of(a, _BARE_ADDR)
    host = F.coalesce(F.concat(F.lit("["), group_of(a, _INET6), F.lit("]")), group_of(a, _INET4),
                      F.when(bare.contains(":"), F.concat(F.lit("["), bare, F.lit("]"))).otherwise(bare))
    port = group_of(a, _PORT)
    return F.coalesce(F.concat(F.lit("unix:"), group_of(a, _SUN_PATH)), F.concat(host, F.lit(":"), port), host)


def route_template(route: Column | str) -> Column:
    segments = F.filter(F.split(F.coalesce(_c(route), F.lit("")), "/"), lambda s: s != "")
    # The parts of a route that stand for an id.
    uuid = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
    named = F.transform(segments, lambda s: F.when(s.rlike("^[0-9]+$"), "{id}").when(s.rlike(uuid), "{uuid}")
                        .when(s.rlike("^[0-9a-fA-F]{16,}$"), "{hex}").otherwise(s))
    return F.concat(F.lit("/"), F.array_join(named, "/"))


def scrub_sql(sql: Column | str) -> Column:
    """Statement shape without literals; a string cut off before its closing quote is scrubbed too."""
    s = F.regexp_replace(_c(sql), "'[^']*'?", "'?'")
    s = F.regexp_replace(s, r"\b\d+\b", "?")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def sql_name(scrubbed: Column) -> Column:
    name = F.substring(scrubbed, 1, 60)
    return F.when(name == "", "query").otherwise(name)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(a1, b1) - F.greatest(a0, b0))


def severity_score(severity: Column, n: Column) -> Column:
    base = F.lit(20.0)
    for name, value in names.SEVERITY_BASE.items():
        base = F.when(severity == name, value).otherwise(base)
    return F.round(base + F.least(n, F.lit(1000)) / 1000 * 9.99, 3)


def severity_rank(severity: Column) -> Column:
    """0 = critical ... 4 = clean; unknown labels rank as clean."""
    rank = F.lit(len(names.SEVERITIES) - 1)
    for i, name in enumerate(names.SEVERITIES[:-1]):
        rank = F.when(severity == name, i).otherwise(rank)
    return rank


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in names.SEVERITIES]), rank + 1)


def live_rank(severity: Column) -> Column:
    rank = F.lit(0)
    for name, value in names.LIVE_RANK.items():
        rank = F.when(severity == name, value).otherwise(rank)
    return rank


def pointer(tok: Column) -> Column:
    """Pointer token to an address: 0x.., (nil) -> 0, plain integer; null otherwise."""
    t = F.regexp_replace(F.trim(tok), ",+$", "")
    return (F.when(t.isin("(nil)", "nil", "NULL", "0"), F.lit(0).cast("long"))
            .when(t.rlike("^0x[0-9a-fA-F]+$"), try_long(F.conv(F.substring(t, 3, 64), 16, 10)))
            .when(t.rlike("^[+-]?[0-9]+$"), try_long(t)))


def _number(tok: Column) -> Column:
    t = F.trim(tok)
    return (F.when(t.rlike("^0x[0-9a-fA-F]+$"), try_long(F.conv(F.substring(t, 3, 64), 16, 10)))
            .when(t.rlike("^[+-]?[0-9]+$"), try_long(t)))


def arg(args: Column | str, i: int) -> Column:
    """i-th comma-separated argument (zero-based), null when missing."""
    return F.get(F.split(F.nullif(_c(args), F.lit("")), ","), F.lit(i))


def alloc_size(fn: Column, args: Column) -> Column:
    a0, a1 = _number(arg(args, 0)), _number(arg(args, 1))
    return (F.when(fn.isin("malloc", "valloc", "pvalloc"), a0)
            .when(fn.isin("calloc", "reallocarray"), F.try_multiply(a0, a1))
            .when(fn.isin("realloc", "aligned_alloc", "memalign"), a1))


def has_any(path: Column, hints: list[str]) -> Column:
    return path.rlike("|".join(re.escape(h) for h in hints))


def is_library_path(path: Column | str) -> Column:
    return F.coalesce(has_any(_c(path), names.LIBRARY_HINTS), F.lit(False))


def is_probe_path(path: Column | str) -> Column:
    """No path counts as probing: it cannot be a miss the program itself caused."""
    p = _c(path)
    return F.when(F.coalesce(p, F.lit("")) == "", True).otherwise(has_any(p, names.PROBE_HINTS))


def is_curation_noise(path: Column | str) -> Column:
    return F.coalesce(has_any(_c(path), names.CURATION_LIBRARY_HINTS), F.lit(False))


def command_name(command: Column | str) -> Column:
    word = F.get(F.split(F.trim(_c(command)), r"\s+"), F.lit(0))
    base = F.regexp_extract(word, "[^/]*$", 0)
    return F.when(F.coalesce(base, F.lit("")) == "", "command").otherwise(base)


# How a control-group path names its runtime, most specific first.
CGROUP_PATTERNS = [
    ("docker", r"docker[-/]([0-9a-f]{64})"),
    ("podman", r"libpod[-/]([0-9a-f]{64})"),
    ("containerd", r"cri-containerd[-/]([0-9a-f]{64})"),
    ("cri-o", r"crio-([0-9a-f]{64})"),
    ("kubernetes", r"kubepods\S*?[-/]([0-9a-f]{64})"),
    ("container", r"(?:^|/)([0-9a-f]{64})(?:\.scope)?(?:/|$)"),
]
_POD_UID = r"pod([0-9a-f]{8}[-_][0-9a-f]{4}[-_][0-9a-f]{4}[-_][0-9a-f]{4}[-_][0-9a-f]{12})"


def container_label(cgroup_text: Column | str) -> Column:
    """STRUCT(container, runtime, id, container_id, cgroup_path, pod_uid) from one process's cgroup text."""
    paths = F.transform(F.split(_c(cgroup_text), "\n"), lambda line: F.element_at(F.split(line, ":", 3), -1))

    def label(path: Column) -> Column:
        runtime, full = F.lit(None).cast("string"), F.lit(None).cast("string")
        for name, rx in reversed(CGROUP_PATTERNS):
            runtime = F.when(path.rlike(rx), name).otherwise(runtime)
            full = F.when(path.rlike(rx), F.regexp_extract(path, rx, 1)).otherwise(full)
        pod = F.regexp_replace(group_of(path, _POD_UID), "_", "-")
        return F.struct(runtime.alias("runtime"), full.alias("container_id"), F.trim(path).alias("cgroup_path"),
                        pod.alias("pod_uid"))

    hit = F.get(F.filter(F.transform(paths, label), lambda s: s["runtime"].isNotNull()), F.lit(0))
    return F.struct(hit.isNotNull().alias("container"), hit["runtime"].alias("runtime"),
                    F.substring(hit["container_id"], 1, 12).alias("id"), hit["container_id"].alias("container_id"),
                    hit["cgroup_path"].alias("cgroup_path"), hit["pod_uid"].alias("pod_uid"))


def _ratio(quota: Column, period: Column) -> Column:
    return F.when((quota > 0) & (period > 0), quota / period)


def cpu_quota_cores(cpu_max: Column, cfs_quota: Column, cfs_period: Column) -> Column:
    """Allowed cores: unified `quota period` text first, then the older pair of files; null when unlimited."""
    parts = F.split(F.trim(cpu_max), r"\s+")
    quota = try_long(F.get(parts, F.lit(0)))
    period = F.when(F.size(parts) > 1, try_long(F.get(parts, F.lit(1)))).otherwise(F.lit(100_000))
    return F.coalesce(_ratio(quota, period), _ratio(try_long(F.trim(cfs_quota)), try_long(F.trim(cfs_period))))


def memory_limit(text: Column) -> Column:
    val = try_long(F.trim(text))
    return F.when((val > 0) & (val < F.lit(1 << 62)), val)


def memory_limit_bytes(memory_max: Column, limit_in_bytes: Column) -> Column:
    return F.coalesce(memory_limit(memory_max), memory_limit(limit_in_bytes))


def unit_ms(unit: Column) -> Column:
    factor = F.lit(None).cast("double")
    for name, value in names.UNIT_MS.items():
        factor = F.when(unit == name, value).otherwise(factor)
    return factor


def connect_result(error: Column | str) -> Column:
    e = _c(error)
    return F.when(e.isin(names.IN_PROGRESS), "connecting").otherwise(F.coalesce(F.nullif(e, F.lit("")), F.lit("ok")))


def timeline_kind(error: Column, lat_us: Column, event_type: Column, call: Column) -> Column:
    return (F.when(F.coalesce(error, F.lit("")) != "", "error").when(lat_us > 100_000, "slow")
            .when(event_type == "signal", "signal").when(call.startswith("exec"), "exec"))


def run_label(status: Column, attach: Column, exit_code: Column, exit_signal: Column) -> Column:
    signalled = F.coalesce(exit_signal, F.lit("")) != ""
    return (F.when(status.isin("running", "analyzing", "error"), status)
            .when(F.coalesce(attach, F.lit(False)),
                  F.when(exit_code.isNull() & ~signalled, "profiled").otherwise("target exited"))
            .when(signalled, exit_signal).when(exit_code == 0, "ok")
            .otherwise(F.concat(F.lit("exit "), F.coalesce(exit_code.cast("string"), F.lit("?")))))


def run_class(status: Column, attach: Column, exit_code: Column) -> Column:
    return (F.when(status.isin("running", "analyzing"), "running").when(status == "error", "fail")
            .when(F.coalesce(attach, F.lit(False)), "ok").when(exit_code == 0, "ok").otherwise("fail"))


def bytes_text(n: Column) -> Column:
    """Half-even like the printed form elsewhere: a power-of-two division makes exact ties common."""
    v = n.cast("double")
    mag = F.abs(v)

    def one(x: Column, unit: str) -> Column:
        return F.format_string(f"%.1f{unit}", F.bround(x, 1))

    return (F.when(F.coalesce(v, F.lit(0.0)) == 0, "0B").when(mag < 1024, F.format_string("%.0fB", F.bround(v, 0)))
            .when(mag < 1024 ** 2, one(v / 1024, "KB")).when(mag < 1024 ** 3, one(v / 1024 ** 2, "MB"))
            .otherwise(one(v / 1024 ** 3, "GB")))
