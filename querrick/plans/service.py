"""The engine behind named methods with checked parameters, as a server would call it."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from ..fixed import DEFAULT_K, RESPONSE_BYTES
from ..functions.sanitise import sanitise
from ..operators.scope import Scope
from ..streaming.changes import Watcher
from .engine import Engine, fit, report, stats_lines
from .indexing import Cancelled, Indexer


def scope_of(value: dict | None) -> Scope | None:
    """A scope from its lists; unknown ones raise ValueError."""
    if value is None:
        return None
    if unknown := set(value) - set(Scope.__dataclass_fields__):
        raise ValueError(f"unknown scope {sorted(unknown)}")
    return Scope(**{k: tuple(v) for k, v in value.items()})


class Service:
    """Methods by name. Answers are plain values; what may be logged of a call is in ``log``."""

    def __init__(self, engine: Engine, indexer: Indexer, watcher: Watcher | None = None) -> None:
        self.engine, self.indexer, self.watcher = engine, indexer, watcher
        self.began, self.log, self.open = time.time(), [], True
        self.state: dict[str, object] = {"phase": "idle", "last": None, "error": None}
        self.indexer.on_phase = lambda phase: self.state.__setitem__("phase", phase)
        self.methods: dict[str, Callable[..., object]] = {
            "search": self.search, "getSymbol": self.engine.get_symbol, "findUsages": self.find_usages, "expandContext": self.engine.expand_context, "readFileLines": self.engine.read_file_lines,
            "index": self.index, "indexAsync": self.index_async, "eval": self.evaluate, "cancel": self.cancel, "status": self.status, "watchStatus": self.watch_status,
            "shutdown": self.shutdown, "ping": lambda: "pong", "health": self.health,
        }

    def call(self, method: str, params: dict | None = None) -> dict:
        """``{"result": ...}`` or ``{"error": {"code", "message"}}``: -32601 for unknown methods, -32602 for wrong parameters, -32000 otherwise."""
        known = self.methods.get(method)
        self.log.append({"method": method, "params": sanitise(params or {}, stripped=True)})
        if known is None:
            return {"error": {"code": -32601, "message": f"no method {method}"}}
        try:
            return {"result": known(**(params or {}))}
        except (ValueError, TypeError) as error:
            return {"error": {"code": -32602, "message": str(error)}}
        except Exception as error:  # noqa: BLE001  the caller gets every failure as an answer
            return {"error": {"code": -32000, "message": str(error)}}

    def search(self, query: str, intent: str = "auto", k: int = DEFAULT_K, scope: dict | None = None, explain: bool = True, max_bytes: int = RESPONSE_BYTES) -> dict:
        within = scope_of(scope)
        return fit(lambda n, why: self.engine.search(query, intent, n, within, why), k, explain, max_bytes)

    def find_usages(self, symbol_id: str | None = None, symbol_name: str | None = None, k: int = 200, scope: dict | None = None) -> dict:
        return self.engine.find_usages(symbol_id, symbol_name, k, scope_of(scope))

    def index(self, force: bool = False) -> dict:
        try:
            self.state["last"], self.state["error"] = self.indexer.index(force), None
            return {"stats": self.state["last"], "text": stats_lines(self.state["last"])}
        except Cancelled:
            self.state["error"] = "cancelled"
            raise
        finally:
            self.state["phase"] = "idle"

    def index_async(self, force: bool = False) -> dict:
        thread = threading.Thread(target=self.call, args=("index", {"force": force}), daemon=True)
        thread.start()
        return {"started": True}

    def evaluate(self, seed: int = 1337, samples: dict | None = None) -> dict:
        result = self.engine.evaluate(seed, samples)
        return {"buckets": result, "text": report(result)}

    def cancel(self) -> dict:
        """Stops a running index; a watcher rests for thirty seconds."""
        self.indexer.cancel()
        if self.watcher:
            self.watcher.pause(30.0)
        return {"cancelled": True}

    def status(self) -> dict:
        return self.engine.status() | {"indexing": dict(self.state), "uptime_s": round(time.time() - self.began, 1)}

    def watch_status(self) -> dict:
        return {"watching": self.watcher is not None} | (dict(self.watcher.stats) | {"paused": self.watcher.is_paused(), "pending": len(self.watcher.pending)} if self.watcher else {})

    def shutdown(self) -> dict:
        self.open = False
        return {"open": False}

    def health(self) -> dict:
        return {"healthy": self.open, "status": self.engine.store.compatibility()["status"]}
