"""Identifier, path, URL and secret functions, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations that occur in identifiers, and what they stand for.
ABBREVIATIONS = {
    "abs": "abstract", "addr": "address", "alloc": "allocate", "arg": "argument", "arr": "array", "assert": "assertion", "attr": "attribute", "auth": "authentication", "authz": "authorization", "bool": "boolean",
    "buf": "buffer", "cap": "capacity", "cb": "callback", "cfg": "config", "chan": "channel", "cli": "client", "cmd": "command", "cnt": "count", "col": "column", "conf": "configuration",
    "conn": "connection", "cred": "credential", "ctor": "constructor", "ctrl": "controller", "ctx": "context", "cur": "current", "db": "database", "dbg": "debug", "dbl": "double", "dealloc": "deallocate",
    "decl": "declaration", "deinit": "deinitialize", "del": "delete", "dep": "dependency", "desc": "description", "dict": "dictionary", "disp": "dispatcher", "doc": "document", "dst": "destination", "dtor": "destructor",
    "dur": "duration", "elem": "element", "env": "environment", "ep": "endpoint", "err": "error", "evt": "event", "ex": "exception", "exc": "exception", "ext": "extension", "flt": "float",
    "fmt": "format", "fn": "function", "func": "function", "hdlr": "handler", "hdr": "header", "hdrs": "headers", "hlp": "helper", "idx": "index", "iface": "interface", "impl": "implementation",
    "inf": "info", "init": "initialize", "int": "integer", "iter": "iterator", "lbl": "label", "len": "length", "lib": "library", "log": "logging", "lst": "list", "lvl": "level",
    "mgr": "manager", "mock": "mock", "mod": "module", "msg": "message", "mtx": "mutex", "ns": "namespace", "num": "number", "obj": "object", "off": "offset", "ops": "operations",
    "opt": "option", "opts": "options", "orig": "original", "param": "parameter", "perm": "permission", "pkg": "package", "pos": "position", "prev": "previous", "proc": "procedure", "prop": "property",
    "ptr": "pointer", "pub": "publisher", "pwd": "password", "que": "queue", "ref": "reference", "reg": "registry", "repo": "repository", "req": "request", "res": "response", "resp": "response",
    "ret": "return", "rm": "remove", "rsp": "response", "sched": "scheduler", "sem": "semaphore", "sess": "session", "sig": "signal", "sock": "socket", "spec": "specification", "src": "source",
    "srv": "server", "stk": "stack", "stmt": "statement", "str": "string", "stub": "stub", "sub": "subscriber", "svc": "service", "sz": "size", "tbl": "table", "temp": "temporary",
    "tgt": "target", "tmp": "temporary", "tok": "token", "trx": "transaction", "ts": "timestamp", "ttl": "timetolive", "txn": "transaction", "txt": "text", "url": "uniform", "util": "utility",
    "val": "value", "vec": "vector", "ver": "version", "wg": "waitgroup", "wrn": "warning",
}


def identifier_tokens(text: Column) -> Column:
    """Words of an identifier: cut at . / _ - space ( ) , : and where a lower-case letter meets an upper-case one; lower-cased, letters and digits alone."""
    cut = F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")
    return F.filter(F.transform(F.split(F.lower(cut), "[./_\\- (),:]+"), lambda w: F.regexp_replace(w, "[^a-z0-9]", "")), lambda w: w != "")


def expanded_tokens(text: Column) -> Column:
    """identifier_tokens, and what its abbreviations stand for after them."""
    table = F.create_map(*(F.lit(x) for pair in ABBREVIATIONS.items() for x in pair))
    tokens = identifier_tokens(text)
    return F.concat(tokens, F.array_compact(F.transform(tokens, lambda w: F.try_element_at(table, w))))


def camel_split(text: Column) -> Column:
    """Camel-case words apart, case kept: cut where a lower-case letter meets an upper-case one, nowhere else."""
    return F.regexp_replace(text, "([a-z])(?=[A-Z])", "$1 ")


def config_key(key: Column) -> Column:
    """A configuration key as lower-case words joined by underscores."""
    words = F.lower(F.regexp_replace(camel_split(key), "[^A-Za-z0-9]+", "_"))
    return F.trim(F.regexp_replace(words, "[_ ]+", "_"), F.lit("_"))


def is_env_name(name: Column) -> Column:
    """Two or more of A-Z, 0-9 and _, a capital among them."""
    return name.rlike("^[A-Z0-9_]{2,}$") & name.rlike("[A-Z]")


def is_config_path(path: Column) -> Column:
    return F.lower(path).rlike(r"(\.(toml|ya?ml|json|ini|cfg|conf|properties|xml|env)|(^|/)\.env(\..*)?)$")


#: Prefixes of vendors' keys, the least characters after them, and parts of names that mark a secret.
KEY_PREFIXES = ["AIza", "jina_", "pa-", "sk-", "sk_", "voy-"]
LEAST_BODY = 20
SECRET_NAMES = ["secret", "password", "passwd", "token", "api_key", "apikey", "private_key", "credential", "auth_token", "access_key", "client_secret", "signing_key", "encryption_key", "ssh_key", "deploy_key", "service_account", "bearer", "jwt_secret"]


def is_secret_value(value: Column) -> Column:
    """Private keys and vendors' key formats, in any case."""
    return value.rlike(r"(?i)-----BEGIN|AKIA[0-9A-Z]{16}|sk-[0-9A-Z]{20}|ghp_[0-9A-Z]{36}|glpat-[0-9A-Z-]{20}|xox[bps]-[0-9A-Z-]")


def is_secret_name(name: Column) -> Column:
    return F.lower(name).rlike("|".join(SECRET_NAMES))


_key = rf"(?<![A-Za-z0-9_])({'|'.join(map(re.escape, sorted(KEY_PREFIXES, key=len, reverse=True)))})[A-Za-z0-9_-]{{{LEAST_BODY},}}"


def scrubbed(text: Column) -> Column:
    """Keys that don't start inside a word, of a known prefix and 20 or more characters, become [REDACTED:prefix]; longer prefixes win. Scrubbing twice changes nothing more."""
    return F.regexp_replace(text, _key, "[REDACTED:$1]")


def redactions(text: Column) -> Column:
    """How many keys scrubbed() takes out."""
    return F.regexp_count(text, F.lit(_key))


def qualified_name(project: Column, path: Column, name: Column | None = None) -> Column:
    """project.dir.parts.name: path segments without the file's extension; a dot-file keeps its name, .. gives nothing."""
    stem = F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")
    parts = F.filter(F.split(stem, "/"), lambda p: (p != "") & (p != "."))
    parts = F.when(F.arrays_overlap(F.split(path, "/"), F.array(F.lit(".."))), F.array().cast("array<string>")).otherwise(parts)
    joined = F.array_join(F.concat(F.array(project), parts, *([F.array(name)] if name is not None else [])), ".")
    return F.when(F.size(parts) == 0, F.lit("")).otherwise(joined)


def project_slug(path: Column) -> Column:
    """A path as a name: non-ASCII bytes as two hexadecimal digits, other unsafe characters as dashes, dashes collapsed and trimmed."""
    chars = F.transform(F.split(path, ""), lambda c: F.when(F.ascii(c) > 127, F.lower(F.hex(F.encode(c, "utf-8")))).when(c.rlike("[A-Za-z0-9._-]"), c).otherwise(F.lit("-")))
    return F.trim(F.regexp_replace(F.array_join(chars, ""), "-+", "-"), F.lit("-"))


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 32)


def url_path(url: Column) -> Column:
    """From the third slash to the question mark."""
    return F.regexp_extract(url, "^[^/]*//[^/]*(/[^?]*)", 1)


def service_of_host(host: Column) -> Column:
    """The service name of a managed container host: name-hash-region.a.run.app or name-hash.region.run.app."""
    return F.regexp_extract(host, r"^(?:https?://)?([a-z][a-z0-9-]*?)-[a-z0-9]{6,}(?:-[a-z]{2})?\.(?:[a-z0-9-]+\.)?run\.app", 1)


def which_patterns(text: Column, patterns: list[str]) -> Column:
    """A bit for each pattern that occurs in the text."""
    bits = F.lit(0).cast("long")
    for k, p in enumerate(patterns):
        bits = bits.bitwiseOR(F.when(text.contains(p), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return bits


def canonical_route(path: Column) -> Column:
    """Parameters of any style, :x {x} <x> ${x}, as {}; a colon inside a segment stays."""
    out = F.regexp_replace(path, r"\$?\{[^}/]*\}", "{}")
    out = F.regexp_replace(out, r"<[^>/]*>", "{}")
    out = F.regexp_replace(out, r"(?<=/):[A-Za-z_][A-Za-z0-9_]*[?*+]?(?=/|$)|^:[A-Za-z_][A-Za-z0-9_]*(?=/|$)", "{}")
    return out


def package_of(qn: Column) -> Column:
    """The third segment of four or more, the second of two or three, else nothing."""
    p = F.split(qn, "\\.")
    return F.when(F.size(p) >= 4, F.get(p, F.lit(2))).when(F.size(p) >= 2, F.get(p, F.lit(1))).otherwise(F.lit(""))


def top_package_of(qn: Column) -> Column:
    return F.coalesce(F.get(F.split(qn, "\\."), F.lit(1)), F.lit(""))


def confidence_band(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.45, "medium").when(score >= 0.25, "speculative").otherwise("")
