"""Master keys: providers, per-table key files, cached keys, failure classes, settings, health."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import os
import random
import re
import threading
import time
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any, Protocol

#: What a key service's key name and context look like.
ARN = re.compile(r"arn:aws(-[^:]+)?:kms:.{1,2000}")
CONTEXT = re.compile(r"[a-zA-Z0-9_-]+=[^,=]+(,[a-zA-Z0-9_-]+=[^,=]+)*")
#: Error types and words of messages that tell a lost key from a passing failure; the last two types of either
#: kind are Python's own.
CRITICAL_TYPES = ("DisabledException", "NotFoundException", "AccessDeniedException", "InvalidKeyUsageException", "KeyUnavailableException", "KMSInvalidStateException", "PermissionError", "KeyError")
TRANSIENT_TYPES = ("ThrottlingException", "RequestLimitExceededException", "TooManyRequestsException", "ServiceUnavailableException", "InternalErrorException", "TimeoutError", "ConnectionError")
CRITICAL_WORDS = ("DisabledException", "NotFoundException", "AccessDeniedException", "InvalidKeyUsageException", "KeyUnavailableException", "KMSInvalidStateException", "access denied", "unauthorized", "forbidden", "key not found", "invalid key", "key disabled", "key revoked")
TRANSIENT_WORDS = ("ThrottlingException", "Rate exceeded", "RequestLimitExceeded", "TooManyRequestsException", "SlowDown", "ServiceUnavailableException", "InternalErrorException", "503 Service Unavailable", "Connection timeout", "Network error")


class KeyProvider(Protocol):
    """A key service: makes data keys and opens wrapped ones."""

    def generate(self, context: Mapping[str, str]) -> tuple[bytes, bytes]:
        """(plain key of 32 bytes, wrapped key)."""

    def unwrap(self, wrapped: bytes, context: Mapping[str, str]) -> bytes:
        """The plain key."""


class DummyProvider:
    """For tests: random keys that are their own wrapping. Protects nothing."""

    def generate(self, context: Mapping[str, str]) -> tuple[bytes, bytes]:
        key = os.urandom(32)
        return key, key

    def unwrap(self, wrapped: bytes, context: Mapping[str, str]) -> bytes:
        return wrapped


def derive(master: bytes, salt: bytes, info: str, length: int = 32) -> bytes:
    """HKDF with SHA-384 (RFC 5869)."""
    if len(master) != 32 or len(salt) != 16 or not 0 < length <= 255 * 48:
        raise ValueError("a master key of 32 bytes, a salt of 16 and a length of at most 12240 are needed")
    secret, out, block = hmac.digest(salt, master, "sha384"), b"", b""
    for i in range(-(-length // 48)):
        block = hmac.digest(secret, block + info.encode() + bytes([i + 1]), "sha384")
        out += block
    return out[:length]


def parse_context(text: str | None) -> dict[str, str]:
    """"k=v,k=v" as a mapping; empty for no text."""
    if not text:
        return {}
    if not CONTEXT.fullmatch(text):
        raise ValueError(f"not an encryption context: {text!r}")
    return dict(x.split("=", 1) for x in text.split(","))


def merge_context(default: str | None, own: str | None) -> dict[str, str]:
    """The default context with the table's own on top."""
    return parse_context(default) | parse_context(own)


def validate(settings: Mapping[str, str]) -> None:
    """Raise ValueError for table settings that can't be used."""
    provider = settings.get("key_provider", "").strip()
    if not provider:
        raise ValueError("key_provider is required")
    arn = settings.get("key_arn")
    if provider == "aws-kms" and not arn:
        raise ValueError("key_arn is required for this key provider")
    if arn and not ARN.fullmatch(arn):
        raise ValueError(f"not a key name: {arn[:80]!r}")
    parse_context(settings.get("encryption_context"))


def classify(error: BaseException) -> str:
    """"critical" or "transient": first by type along the causes, then by message; unknown failures are transient."""
    chain, seen = [], set()
    e: BaseException | None = error
    while e is not None and id(e) not in seen:
        seen.add(id(e))
        chain.append(e)
        e = e.__cause__ or e.__context__
    names, text = [type(x).__name__ for x in chain], " ".join(str(x).lower() for x in chain)
    for kind, types in (("critical", CRITICAL_TYPES), ("transient", TRANSIENT_TYPES)):
        if any(n in types for n in names):
            return kind
    for kind, words in (("critical", CRITICAL_WORDS), ("transient", TRANSIENT_WORDS)):
        if any(w.lower() in text for w in words):
            return kind
    return "transient"


@dataclass
class KeyCache:
    """Keys by table, or their ids, loaded on a miss and kept for `ttl` seconds (-1: for good)."""

    load: Callable[[str], Any]
    ttl: float = 86_400
    clock: Callable[[], float] = time.monotonic
    _held: dict[str, tuple[float, Any]] = field(default_factory=dict, repr=False)
    _lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def get(self, table: str) -> Any:
        with self._lock:
            held = self._held.get(table)
            if held and (self.ttl < 0 or self.clock() - held[0] < self.ttl):
                return held[1]
            key = self.load(table)
            self._held[table] = (self.clock(), key)
            return key

    def has(self, table: str) -> bool:
        with self._lock:
            held = self._held.get(table)
            return bool(held) and (self.ttl < 0 or self.clock() - held[0] < self.ttl)

    def refresh(self, table: str) -> None:
        """Load a held key anew; a failure keeps the old one and is raised."""
        with self._lock:
            if table in self._held:
                self._held[table] = (self.clock(), self.load(table))

    def invalidate(self, table: str) -> None:
        with self._lock:
            self._held.pop(table, None)


@dataclass
class Health:
    """Blocks of tables whose key is lost: writes at once, reads after a grace; both are lifted when the key is back."""

    cache: KeyCache
    grace: float = 10.0
    clock: Callable[[], float] = time.monotonic
    failures: dict[str, tuple[str, float]] = field(default_factory=dict)

    def check(self, table: str) -> str:
        """Look at one table's key: "healthy", "transient" or "critical". A critical failure never becomes transient."""
        try:
            if self.cache.has(table):
                self.cache.refresh(table)
            else:
                self.cache.get(table)
        except Exception as e:  # noqa: BLE001  any failure of a key service is classified
            kind = classify(e)
            before = self.failures.get(table)
            if before and before[0] == "critical":
                return "critical"
            self.failures[table] = (kind, self.clock())
            return kind
        self.failures.pop(table, None)
        return "healthy"

    def _lost(self, table: str) -> float | None:
        kind, since = self.failures.get(table, ("", 0.0))
        return since if kind == "critical" and not self.cache.has(table) else None

    def may_write(self, table: str) -> bool:
        return self._lost(table) is None

    def may_read(self, table: str) -> bool:
        since = self._lost(table)
        return since is None or self.clock() - since < self.grace

    def watch(self, tables: Callable[[], Iterable[str]], interval: float = 3600.0, jitter: float = 300.0) -> threading.Event:
        """Check all tables every interval, each round a random part of `jitter` later, until the returned event is set."""
        stop = threading.Event()

        def run() -> None:
            while not stop.wait(interval + random.uniform(0, jitter)):
                for table in tables():
                    self.check(table)

        threading.Thread(target=run, daemon=True).start()
        return stop


def fingerprint(key: bytes) -> str:
    """A name for a key that doesn't tell it."""
    return hashlib.sha256(b"sealframe key " + key).hexdigest()[:32]


@dataclass(frozen=True)
class KeyDirectory:
    """Table keys for Parquet's encryption, one file a key, in a directory that executors read and nobody else may.

    It stands for a key service next to the cluster. The table's key file, beside its data, holds the wrapped key, the
    provider's name and the context.
    """

    path: str
    providers: Mapping[str, KeyProvider] = field(default_factory=lambda: {"dummy": DummyProvider()})

    def create(self, keyfile: str, settings: Mapping[str, str]) -> str:
        """Make a table's key and key file, once: of several at a time one wins. Returns the key's id."""
        validate(settings)
        provider = self._provider(settings["key_provider"])
        key, wrapped = provider.generate(parse_context(settings.get("encryption_context")))
        body = dict(settings) | {"wrapped": base64.b64encode(wrapped).decode(), "key_id": fingerprint(key)}
        part = f"{keyfile}.{os.getpid()}.{threading.get_ident()}"
        with open(part, "w") as f:
            json.dump(body, f)
        try:
            os.link(part, keyfile)  # atomic, and fails if another was first
        except FileExistsError:
            pass
        finally:
            os.unlink(part)
        return self.open(keyfile)

    def open(self, keyfile: str) -> str:
        """The id of the key of an existing key file, whose plain key is put in place."""
        with open(keyfile) as f:
            body = json.load(f)
        key = self._provider(body["key_provider"]).unwrap(base64.b64decode(body["wrapped"]), parse_context(body.get("encryption_context")))
        if not hmac.compare_digest(fingerprint(key), body["key_id"]):
            raise PermissionError("the key service opened another key than the table's")
        os.makedirs(self.path, mode=0o700, exist_ok=True)
        place = os.path.join(self.path, f"{body['key_id']}.key")
        if not os.path.exists(place):
            with open(fd := os.open(f"{place}.{os.getpid()}.{threading.get_ident()}", os.O_WRONLY | os.O_CREAT, 0o600), "wb") as f:
                f.write(key)
            del fd
            os.replace(f"{place}.{os.getpid()}.{threading.get_ident()}", place)
        return body["key_id"]

    def _provider(self, name: str) -> KeyProvider:
        if name not in self.providers:
            raise ValueError(f"no key provider {name!r}")
        return self.providers[name]
