"""Corpus ledger: which corpora may be used for what. Driver-side, one small file, atomic replace."""

from __future__ import annotations

import hashlib
import json
import os
import time
from contextlib import contextmanager, suppress

from ..sources.manifest import canonical_json, file_digest, fingerprint, save_json


class PolicyError(Exception):
    pass


@contextmanager
def locked(path: str, wait: float = 10.0, stale: float = 30.0):
    """A directory as lock; one older than ``stale`` seconds is taken over."""
    lock, began = f"{path}.lock", time.monotonic()
    while True:
        try:
            os.mkdir(lock)
            break
        except FileExistsError:
            try:
                if time.time() - os.stat(lock).st_mtime > stale:
                    os.rmdir(lock)
                    continue
            except FileNotFoundError:
                continue
            if time.monotonic() - began > wait:
                raise PolicyError("ledger is locked") from None
            time.sleep(0.02)
    try:
        yield
    finally:
        with suppress(FileNotFoundError):  # taken over as stale, and given back
            os.rmdir(lock)


def load(path: str) -> dict:
    if not os.path.exists(path):
        return {"version": 1, "corpora": {}}
    with open(path) as f:
        return json.load(f)


#: (state, action) to the state after it.
MOVES = {
    (None, "develop"): "development", ("development", "develop"): "development", (None, "seal"): "sealed", ("sealed", "evaluate"): "evaluated",
    ("evaluated", "evaluate"): "evaluated", ("sealed", "invalidate"): "invalidated", ("evaluated", "invalidate"): "invalidated",
}


def act(path: str, corpus: str, action: str, name: str = "", configuration: str | None = None, blocked: bool = False, reason: str | None = None) -> str:
    """Moves a corpus (by fingerprint) on; returns its new state. Raises PolicyError for a move that isn't allowed."""
    with locked(path):
        ledger = load(path)
        entry = ledger["corpora"].get(corpus)
        state = entry and entry["state"]
        if action == "seal" and blocked:
            raise PolicyError("a development corpus can't be sealed")
        after = MOVES.get((state, action))
        if after is None:
            raise PolicyError(f"{action} isn't allowed from {state or 'absent'}")
        if action == "evaluate" and entry["configuration_sha256"] != configuration:
            raise PolicyError("the configuration changed since sealing")
        entry = dict(entry or {"name": name, "configuration_sha256": configuration})
        entry["state"] = after
        if reason:
            entry["reason"] = reason
        entry.setdefault(f"{after}_at", time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()))
        ledger["corpora"][corpus] = entry
        save_json(ledger, path)
        return after


def blocked_corpora(manifest: dict, policy: dict) -> list[str]:
    """Names of the policy's development corpora that a manifest's tracks come from: by a prefix of their id or by their source's name."""
    found = []
    for corpus in policy.get("development_corpora", []):
        prefixes, sources = tuple(corpus.get("id_prefixes", ())), set(corpus.get("source_names", ()))
        if any((prefixes and t["id"].startswith(prefixes)) or (t.get("source") or {}).get("name") in sources for t in manifest.get("tracks", [])):
            found.append(corpus["name"])
    return found


def _json(path: str) -> dict:
    with open(path) as f:
        return json.load(f)


def seal(ledger: str, manifest_path: str, name: str, configuration_path: str, policy_path: str, receipt: str | None = None) -> str:
    """Seals a corpus for one evaluation; returns its fingerprint. ``receipt`` is written once and never over another."""
    manifest, policy = _json(manifest_path), _json(policy_path)
    stopped = blocked_corpora(manifest, policy)
    if stopped:
        raise PolicyError(f"a development corpus can't be sealed: {', '.join(stopped)}")
    if receipt and os.path.exists(receipt):
        raise PolicyError(f"there is a receipt already: {receipt}")
    corpus, configuration = fingerprint(manifest), file_digest(configuration_path)
    act(ledger, corpus, "seal", name, configuration)
    if receipt:
        os.makedirs(os.path.dirname(receipt) or ".", exist_ok=True)
        row = {"version": 1, "corpus_name": name, "corpus_sha256": corpus, "configuration_sha256": configuration, "policy_sha256": hashlib.sha256(canonical_json(policy)).hexdigest(), "track_count": len(manifest["tracks"])}
        try:
            with open(receipt, "x") as f:
                json.dump(row, f, indent=2, sort_keys=True)
        except FileExistsError:
            raise PolicyError(f"there is a receipt already: {receipt}") from None
    return corpus


def authorize(ledger: str, manifest_path: str, name: str, role: str, configuration_path: str) -> str:
    """The gate before a run: registers a development corpus, or uses up a sealed one under the configuration it was sealed with."""
    corpus = fingerprint(_json(manifest_path))
    act(ledger, corpus, "develop" if role == "development" else "evaluate", name, None if role == "development" else file_digest(configuration_path))
    return corpus


def evaluate_corpus(spark, ledger: str, manifest_path: str, name: str, role: str, configuration_path: str) -> tuple[dict, object]:
    """(metadata, results): the manifest evaluated by ``operators.corpus.run_manifest``, only if the ledger allows it."""
    from ..operators.corpus import run_manifest

    corpus = authorize(ledger, manifest_path, name, role, configuration_path)
    meta = {"corpus_name": name, "corpus_fingerprint": corpus, "corpus_role": role, "configuration_sha256": file_digest(configuration_path), "evaluated_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
    return meta, run_manifest(spark, manifest_path)


def checked_model(path: str, sha256: str) -> str:
    """``path``, if the file there has the digest."""
    if (found := file_digest(path)) != sha256:
        raise PolicyError(f"model checksum: expected {sha256}, found {found}")
    return path
