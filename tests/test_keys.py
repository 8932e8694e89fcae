"""Settings, failure classes, derivation, cached keys and health, by tables of cases."""

import hashlib
import hmac

import pytest

from sealframe.crypto import keys as K


@pytest.mark.parametrize("arn", ["arn:aws:s3:::b", "arn:gcp:kms:x", "arn:aws:kms:", "arn:aws:kms:" + "x" * 2001, "x"])
def test_bad_key_names(arn):
    with pytest.raises(ValueError):
        K.validate({"key_provider": "aws-kms", "key_arn": arn})


@pytest.mark.parametrize("arn", ["arn:aws:kms:r:1:key/a", "arn:aws-cn:kms:r:1:key/a", "arn:aws-us-gov:kms:r:1:key/a", "arn:aws:kms:r:1:alias/x", "arn:aws:kms::1:key/a"])
def test_good_key_names(arn):
    K.validate({"key_provider": "aws-kms", "key_arn": arn})


def test_needed_settings():
    for settings in ({}, {"key_provider": " "}, {"key_provider": "aws-kms"}):
        with pytest.raises(ValueError):
            K.validate(settings)
    K.validate({"key_provider": "dummy"})


@pytest.mark.parametrize("text", ["a = b", "=value1", "key1=", "key1==value1", "a=b,,c=d", "a"])
def test_bad_contexts(text):
    with pytest.raises(ValueError):
        K.parse_context(text)


def test_contexts_merge():
    assert K.parse_context("") == {} and K.parse_context("a-1=b:c,d_2=e") == {"a-1": "b:c", "d_2": "e"}
    assert K.merge_context("a=1,b=2", "b=3") == {"a": "1", "b": "3"}


class DisabledException(Exception):
    pass


class ThrottlingException(Exception):
    pass


def wrapped(inner):
    try:
        try:
            raise inner
        except Exception as e:
            raise RuntimeError("outer") from e
    except RuntimeError as e:
        return e


@pytest.mark.parametrize(("error", "kind"), [(DisabledException(), "critical"), (RuntimeError("Access Denied for key"), "critical"), (wrapped(DisabledException()), "critical"), (ThrottlingException("access denied"), "transient"), (RuntimeError("503"), "transient"), (TimeoutError(), "transient"), (RuntimeError("?"), "transient")])
def test_classes(error, kind):
    assert K.classify(error) == kind


@pytest.mark.parametrize(("message", "kind"), [("Unauthorized", "critical"), ("request forbidden", "critical"), ("key revoked", "critical"), ("key not found in region", "critical"), ("shard not found", "transient"), ("SlowDown", "transient"), ("Connection timeout", "transient")])
def test_classes_by_words(message, kind):
    assert K.classify(RuntimeError(message)) == kind


def test_contexts_with_spaces_in_values():
    assert K.parse_context("team=a b,x=1") == {"team": "a b", "x": "1"}
    with pytest.raises(ValueError):
        K.parse_context("a.b=1")


def test_derivation():
    master, salt = b"\x42" * 32, b"\x24" * 16
    first = hmac.new(hmac.new(salt, master, hashlib.sha384).digest(), b"file-encryption\x01", hashlib.sha384).digest()
    assert K.derive(master, salt, "file-encryption") == first[:32]
    assert K.derive(master, salt, "frame-1", 16) != K.derive(master, salt, "frame-2", 16) and len(K.derive(master, salt, "x", 100)) == 100
    with pytest.raises(ValueError):
        K.derive(b"short", salt, "x")


def test_cache_and_health():
    now, answers = [0.0], {"t": b"k1"}

    def load(table):
        if isinstance(answers[table], Exception):
            raise answers[table]
        return answers[table]

    cache = K.KeyCache(load, ttl=100, clock=lambda: now[0])
    health = K.Health(cache, grace=10, clock=lambda: now[0])
    assert health.check("t") == "healthy" and cache.get("t") == b"k1"
    answers["t"] = DisabledException()
    assert health.check("t") == "critical" and cache.get("t") == b"k1"  # a held key keeps working
    assert health.may_write("t")
    now[0] = 101
    assert health.check("t") == "critical" and not health.may_write("t")
    health.failures["t"] = ("critical", 101.0)
    assert health.may_read("t")
    now[0] = 112
    assert not health.may_read("t")
    answers["t"] = TimeoutError()
    assert health.check("t") == "critical"  # never less
    answers["t"] = b"k2"
    assert health.check("t") == "healthy" and health.may_write("t") and health.may_read("t") and cache.get("t") == b"k2"
    answers["t"] = TimeoutError()
    now[0] = 300
    assert health.check("t") == "transient" and health.may_write("t")
    forever = K.KeyCache(lambda t: b"x", ttl=-1, clock=lambda: now[0])
    forever.get("t")
    now[0] = 1e9
    assert forever.has("t")
    forever.invalidate("t")
    assert not forever.has("t")


def test_a_provider_that_opens_another_key(tmp_path):
    directory = K.KeyDirectory(str(tmp_path / "k"))
    directory.create(str(tmp_path / "keyfile"), {"key_provider": "dummy"})
    import json

    body = json.loads((tmp_path / "keyfile").read_text())
    body["wrapped"] = "AAAA" * 10 + "AAA="
    (tmp_path / "keyfile").write_text(json.dumps(body))
    with pytest.raises(PermissionError):
        directory.open(str(tmp_path / "keyfile"))
    with pytest.raises(ValueError, match="no key provider"):
        directory.create(str(tmp_path / "other"), {"key_provider": "unknown"})


def test_the_jar_is_what_its_source_compiles_to(tmp_path):
    import shutil
    import subprocess
    import zipfile
    from pathlib import Path

    import pyspark

    from sealframe.crypto.parquet import JAR

    if shutil.which("javac") is None:
        pytest.skip("no Java compiler")
    source = JAR.parent / "java" / "KeyDirectoryKmsClient.java"
    subprocess.run(["javac", "-cp", str(Path(pyspark.__file__).parent / "jars" / "*"), "-d", str(tmp_path), str(source)], check=True)
    built = {str(x.relative_to(tmp_path)): x.read_bytes() for x in tmp_path.rglob("*.class")}
    with zipfile.ZipFile(JAR) as jar:
        held = {x: jar.read(x) for x in jar.namelist() if x.endswith(".class")}
    assert built.keys() == held.keys()
    if any(built[x][4:8] != held[x][4:8] for x in built):
        pytest.skip("another version of the compiler")
    assert built == held
