"""Project bundles: manifest, fingerprint, and handlers compiled to filters."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import parse_qs, unquote, urlsplit

from ..errors import ConfigError
from ..functions.keccak import event_topic, selector
from ..operators.filters import BLOCK, LOG, MOST_TOPICS, TRANSACTION, BlockFilter, Handler, LogFilter, TransactionFilter
from . import sdl

MANIFESTS = ("project.yaml", "project.yml")
# Kinds that a manifest may name.
SOURCE_KIND = "evm/Runtime"
HANDLER_KINDS = {"evm/LogHandler": LOG, "evm/TransactionHandler": TRANSACTION, "evm/BlockHandler": BLOCK}
_OPTIONS = {"address", "abi"}
_DOMAIN = b"blockloom-project-v1"


def check_endpoint(raw: str) -> str:
    """http or https, a host, no fragment."""
    url = urlsplit(raw)
    if url.scheme not in ("http", "https") or not url.hostname:
        raise ConfigError("endpoints need http or https and a host")
    if url.fragment or raw.endswith("#"):
        raise ConfigError("endpoints must not have a fragment")
    return raw


def redact(raw: str) -> str:
    """The origin alone."""
    url = urlsplit(raw)
    if not url.scheme or not url.hostname:
        return "***"
    usual = {"http": 80, "https": 443}.get(url.scheme)
    return f"{url.scheme}://{url.hostname}" + (f":{url.port}" if url.port and url.port != usual else "")


def read_inside(root: Path, relative: str) -> bytes:
    """A file of the bundle; paths and links that leave it are refused."""
    if Path(relative).is_absolute():
        raise ConfigError("project paths must be relative")
    path = (root / relative).resolve()
    if not path.is_relative_to(root):
        raise ConfigError(f"{relative} leaves the project")
    if not path.is_file():
        raise ConfigError(f"{relative}: no such file")
    return path.read_bytes()


@dataclass(frozen=True)
class Project:
    manifest: dict
    root: Path
    entities: tuple[sdl.Entity, ...]
    fingerprint: str

    @property
    def chain_id(self) -> str:
        return str(self.manifest["network"]["chainId"])

    @property
    def endpoints(self) -> list[str]:
        return [check_endpoint(x) for x in self.manifest["network"].get("endpoint") or []]

    def handlers(self) -> list[Handler]:
        return compile_handlers(self.manifest)


def load(directory: str | Path) -> Project:
    import yaml

    root = Path(directory).resolve()
    found = [root / n for n in MANIFESTS if (root / n).is_file()]
    if len(found) != 1:
        raise ConfigError("a project has exactly one project.yaml or project.yml")
    manifest = yaml.safe_load(found[0].read_text(encoding="utf-8"))
    if not isinstance(manifest, dict):
        raise ConfigError("the manifest is no mapping")
    for key in ("specVersion", "name", "version", "network", "schema", "dataSources"):
        if key not in manifest:
            raise ConfigError(f"the manifest lacks {key}")
    for ds in manifest["dataSources"]:
        if ds.get("kind") != SOURCE_KIND:
            raise ConfigError(f"unsupported data source kind {ds.get('kind')}")
        for h in ds.get("handlers") or []:
            if h.get("kind") not in HANDLER_KINDS:
                raise ConfigError(f"unsupported handler kind {h.get('kind')}")
    return Project(manifest, root, tuple(sdl.parse(read_inside(root, manifest["schema"]["file"]).decode())), fingerprint(manifest, root))


def digest(parts: list[bytes]) -> str:
    """SHA-256 over parts, each behind its length, so that no two lists of parts read alike."""
    h = hashlib.sha256()
    for part in parts:
        h.update(len(part).to_bytes(8, "big") + part)
    return h.hexdigest()


def fingerprint_parts(manifest: dict, schema: bytes, assets: list[tuple[str, bytes]]) -> list[bytes]:
    """The manifest as canonical JSON, the schema, every asset's name and bytes."""
    canonical = json.dumps(manifest, sort_keys=True, separators=(",", ":"), default=str).encode()
    return [_DOMAIN, canonical, schema, *[x for name, data in assets for x in (name.encode(), data)]]


def fingerprint(manifest: dict, root: Path) -> str:
    assets = [(name, read_inside(root, asset["file"])) for ds in manifest["dataSources"] for name, asset in sorted((ds.get("assets") or {}).items())]
    return digest(fingerprint_parts(manifest, read_inside(root, manifest["schema"]["file"]), assets))


def _hex(raw: object, size: int, what: str) -> str | None:
    if raw is None:
        return None
    if not isinstance(raw, str) or not re.fullmatch(rf"0x[0-9a-fA-F]{{{2 * size}}}", raw):
        raise ConfigError(f"invalid {what}")
    return raw.lower()


_SIGNATURE = re.compile(r"\s*(?:(?:event|function)\s+)?([A-Za-z_$][A-Za-z0-9_$]*)\s*", re.S)
_ARRAYS = re.compile(r"(?:\[\d*\])*")
_PLAIN = re.compile(r"[a-z][A-Za-z0-9]*")
_BEHIND = re.compile(r"(?:\s|$).*", re.S)


def _inside(raw: str, at: int) -> tuple[list[str], int]:
    """The parameters of the parenthesis at a place, cut at its own commas; and the place behind it."""
    depth, start, out = 0, at + 1, []
    for i in range(at, len(raw)):
        c = raw[i]
        depth += (c == "(") - (c == ")")
        if depth == 1 and c == "," or depth == 0:
            out.append(raw[start:i].strip())
            start = i + 1
        if depth == 0:
            return (out if out != [""] else []), i + 1
    raise ValueError(raw)


def _canonical_type(raw: str) -> str:
    """A parameter's type: a tuple as its members' types, uint as uint256; its name and ``indexed`` go."""
    body = re.sub(r"^tuple\s*(?=\()", "", raw)
    if body.startswith("("):
        parts, end = _inside(body, 0)
        arrays = _ARRAYS.match(body, end)
        kind, end = f"({','.join(map(_canonical_type, parts))})", arrays.end()
    else:
        plain = _PLAIN.match(body)
        if plain is None:
            raise ValueError(raw)
        arrays = _ARRAYS.match(body, plain.end())
        kind, end = {"uint": "uint256", "int": "int256"}.get(plain[0], plain[0]), arrays.end()
    if not _BEHIND.fullmatch(body[end:]) or not re.fullmatch(r"\s*(?:[A-Za-z_$][A-Za-z0-9_$]*\s*){0,3}", body[end:]):
        raise ValueError(raw)
    return kind + arrays[0]


def canonical_signature(raw: str) -> str:
    """Name and parameter types alone: no names, no ``indexed``, uint as uint256, tuples as their members."""
    m = _SIGNATURE.match(raw)
    try:
        if not m or raw[m.end() : m.end() + 1] != "(":
            raise ValueError(raw)
        parts, _ = _inside(raw, m.end())
        return f"{m[1]}({','.join(map(_canonical_type, parts))})"
    except ValueError:
        raise ConfigError(f"invalid signature {raw!r}") from None


def instantiated(manifest: dict, template: str, parameters: dict, created_at: int) -> dict:
    """The data source that a template gives: its parameters are its options, and it is active from the block that created it."""
    for t in manifest.get("templates") or []:
        if t.get("name") == template:
            return t | {"options": (t.get("options") or {}) | parameters, "startBlock": created_at}
    raise ConfigError(f"no template {template}")


def active_handlers(manifest: dict, dynamic: list[tuple[str, dict, int]] = ()) -> list[Handler]:
    """Handlers of the manifest's data sources and of those that handlers created: (template, parameters, height), in the order they came, each once."""
    seen, more = set(), []
    for template, parameters, height in dynamic:
        key = template, json.dumps(parameters, sort_keys=True)
        if key not in seen:
            seen.add(key)
            more.append(instantiated(manifest, template, parameters, height))
    return compile_handlers(manifest | {"dataSources": [*manifest["dataSources"], *more]})


def compile_handlers(manifest: dict) -> list[Handler]:
    """Signatures are hashed once, here; what the engine does not support is refused."""
    out = []
    for ds in manifest["dataSources"]:
        options = ds.get("options") or {}
        if set(options) - _OPTIONS:
            raise ConfigError(f"unsupported options {sorted(set(options) - _OPTIONS)}")
        contract = _hex(options.get("address"), 20, "address")
        start = max(int(manifest.get("startBlock") or 0), int(ds.get("startBlock") or 0))
        end = ds.get("endBlock")
        for h in ds.get("handlers") or []:
            spec, kind = h.get("filter") or {}, HANDLER_KINDS[h["kind"]]
            bad = ConfigError(f"invalid or unsupported filter for {h['handler']}")
            if kind == LOG:
                if set(spec) - {"event", "topics"} or spec.get("topics") and "event" not in spec:
                    raise bad
                topics = ([event_topic(canonical_signature(spec["event"]))] if "event" in spec else []) + [_hex(t, 32, "topic") for t in spec.get("topics") or []]
                if len(topics) > MOST_TOPICS:
                    raise bad
                own: object = LogFilter(contract, tuple(topics))
            elif kind == TRANSACTION:
                if set(spec) - {"function", "from", "to"} or spec and "function" not in spec:
                    raise bad
                to = _hex(spec.get("to"), 20, "address")
                if to and contract and to != contract:
                    raise bad
                own = TransactionFilter(to or contract, _hex(spec.get("from"), 20, "address"), selector(canonical_signature(spec["function"])) if spec else None)
            else:
                if set(spec) - {"modulo", "timestamp"} or spec.get("timestamp") is not None or spec.get("modulo") == 0:
                    raise bad
                own = BlockFilter(spec.get("modulo"))
            out.append(Handler(h["handler"], kind, own, start, end))
    return out


@dataclass(frozen=True)
class DatabaseConfig:
    """Options of a JDBC sink, from a URL or from DB_* variables; the URL wins."""

    host: str = "localhost"
    port: int = 5432
    username: str = "postgres"
    password: str = "postgres"
    database: str = "postgres"
    schema: str = "app"

    @classmethod
    def resolve(cls, url: str | None, env: dict[str, str]) -> DatabaseConfig:
        base = cls()
        if url is None:
            port = env.get("DB_PORT", "")
            return cls(env.get("DB_HOST", base.host), int(port) if port.isdigit() else base.port, env.get("DB_USER", base.username), env.get("DB_PASS", base.password), env.get("DB_DATABASE", base.database), env.get("DB_SCHEMA", base.schema))
        u = urlsplit(url)
        if u.scheme not in ("postgres", "postgresql"):
            raise ConfigError(f"unsupported scheme {u.scheme}")
        name = unquote(u.path.lstrip("/"))
        if not name:
            raise ConfigError("no database named")
        return cls(u.hostname or base.host, u.port or base.port, unquote(u.username or base.username), unquote(u.password) if u.password else base.password, name, parse_qs(u.query).get("schema", [base.schema])[0])

    def jdbc(self) -> dict[str, str]:
        return {"url": f"jdbc:postgresql://{self.host}:{self.port}/{self.database}?currentSchema={self.schema}", "user": self.username, "password": self.password}


@dataclass(frozen=True)
class IngestConfig:
    """Settings of a run, checked across fields."""

    batch_size: int = 100
    max_in_flight: int = 8
    queue_capacity: int = 200
    rpc_timeout_secs: int = 30
    rpc_max_retries: int = 5
    workers: int = 4
    query_limit: int = 100
    finality_confirmations: int = 200
    start_height: int | None = None
    end_height: int | None = None
    unfinalized: bool = False
    historical: str = "height"
    ingest_only: bool = True
    bypass: tuple[tuple[int, int], ...] = ()

    def __post_init__(self) -> None:
        for name in ("batch_size", "max_in_flight", "queue_capacity", "rpc_timeout_secs", "rpc_max_retries", "workers", "query_limit"):
            if getattr(self, name) < 1:
                raise ConfigError(f"{name} must be at least 1")
        if any(h is not None and not 0 <= h < 1 << 63 for h in (self.start_height, self.end_height)):
            raise ConfigError("heights must fit a bigint")
        if self.historical not in ("height", "timestamp", "disabled"):
            raise ConfigError(f"unknown history {self.historical}")
        if self.ingest_only and self.unfinalized:
            raise ConfigError("ingest only takes finalized blocks")
        if self.start_height is not None and self.end_height is not None and self.end_height < self.start_height:
            raise ConfigError("end is below start")
        if self.unfinalized and self.historical == "disabled":
            raise ConfigError("unfinalized blocks need history to rewind")
        if self.queue_capacity < self.batch_size:
            raise ConfigError("queue capacity is below the batch size")
