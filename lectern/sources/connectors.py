"""Connectors to services that answer prompts: two HTTP shapes and a local program, with retries, validation and a bound on
requests at once. All are plain callables for ``enrich.resolve`` and ``books.translate``, made in the task that uses them."""

from __future__ import annotations

import json
import os
import subprocess
import tempfile
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable

from ..functions import rules

Answer = Callable[[str | None, str], str]


class Fatal(RuntimeError):
    """A failure that no retry mends."""


def waits(first: float, most: float, tries: int) -> list[float]:
    """Seconds before each further try: doubling up to ``most``."""
    return [min(first * 2**k, most) for k in range(tries - 1)]


def with_retries(ask: Callable[[], str], pauses: list[float], passing: Callable[[Exception], bool], check: Callable[[str], str | None] | None = None, sleep=time.sleep) -> str:
    """What ``ask`` gives. A failure that is ``passing``, or an answer that ``check`` gives a reason against, is tried again
    after each of the pauses."""
    for pause in [*pauses, None]:
        try:
            out = ask()
            reason = check(out) if check else None
            if reason is None:
                return out
            error: Exception = ValueError(reason)
        except Exception as e:  # noqa: BLE001  which failures pass is the caller's to say
            if not passing(e):
                raise
            error = e
        if pause is None:
            raise error
        sleep(pause)
    raise AssertionError


def is_fatal(message: str) -> bool:
    low = message.lower()
    return any(m in low for m in rules.FATAL_MARKERS)


def endpoint(base: str, last: str) -> str:
    """A base address completed to /v1/``last``."""
    bare = base.rstrip("/")
    return bare if bare.endswith(f"/{last}") else f"{bare}/{last}" if bare.endswith("/v1") else f"{bare}/v1/{last}"


def _post(url: str, headers: dict, body: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as r:
        return json.loads(r.read())


def text_parts(data: dict) -> str:
    """The text of an answer made of typed parts; an answer without any is an error."""
    parts = [str(p.get("text", "")) for p in data.get("content", []) if isinstance(p, dict) and p.get("type") == "text"]
    if not parts:
        raise ValueError(f"no text in the answer: {json.dumps(data)[:1000]}")
    return "".join(parts)


def passing_status(statuses: list[int]) -> Callable[[Exception], bool]:
    """Of HTTP errors those with one of the statuses, and failures of the network."""
    return lambda e: e.code in statuses if isinstance(e, urllib.error.HTTPError) else isinstance(e, (urllib.error.URLError, TimeoutError, ConnectionError))


def chat(base: str, key: str, model: str, parts: bool = False, extra: dict | None = None, headers: dict | None = None, max_tokens: int = 4096, timeout: float = 300, tries: int = 5, check=None, sleep=time.sleep) -> Answer:
    """A connector by HTTP. ``parts``: the shape with a system field and typed parts, else that with choices. Statuses of
    ``rules.RETRY_STATUS`` and network failures are tried again, 5 seconds later at first, 60 at most. ``headers``: what a
    service wants beside the key, such as a version."""
    url = endpoint(base, "messages" if parts else "chat/completions")
    sent = {"Authorization": f"Bearer {key}"} | ({"x-api-key": key} if parts else {}) | (headers or {})

    def answer(system: str | None, user: str) -> str:
        turns = [{"role": "user", "content": user}]
        body = {"model": model, "max_tokens": max_tokens}
        body |= {"system": system or "", "messages": turns} if parts else {"messages": [{"role": "system", "content": system or ""}, *turns]}

        def ask() -> str:
            data = _post(url, sent, body | (extra or {}), timeout)
            return text_parts(data) if parts else data["choices"][0]["message"]["content"]

        return with_retries(ask, waits(5, 60, tries), passing_status(rules.RETRY_STATUS), check, sleep)

    return answer


def steady(answer: Answer, tries: int = 5, pause: float = 6, check=None, sleep=time.sleep) -> Answer:
    """A connector that tries again after any failure, always after the same pause."""
    return lambda system, user: with_retries(lambda: answer(system, user), [pause] * (tries - 1), lambda e: True, check, sleep)


def child_environment(deny: tuple[str, ...] = (), deny_prefixes: tuple[str, ...] = (), allow: tuple[str, ...] = (), source: dict | None = None) -> dict[str, str]:
    """The variables that a program gets: none that is denied by name, nor by prefix unless it is allowed."""
    every = os.environ if source is None else source
    return {k: v for k, v in every.items() if k not in deny and (k in allow or not k.startswith(deny_prefixes or ("\0",)))}


def without_socks(source: dict) -> dict[str, str]:
    """Variables without proxies that HTTP clients can't use."""
    names = {"all_proxy", "http_proxy", "https_proxy"}
    return {k: v for k, v in source.items() if not (k.lower() in names and v.lower().startswith("socks://"))}


_GATE = threading.Condition()
_RUNNING = 0


class gate:  # noqa: N801  used like a function
    """At most ``most`` requests of a process at once (0: no bound)."""

    def __init__(self, most: int):
        self.most = most

    def __enter__(self):
        global _RUNNING
        with _GATE:
            _GATE.wait_for(lambda: not self.most or _RUNNING < self.most)
            _RUNNING += 1

    def __exit__(self, *_):
        global _RUNNING
        with _GATE:
            _RUNNING -= 1
            _GATE.notify_all()


def program(command: list[str], environment: dict | None = None, most: int = 0, timeout: float = 600, tries: int = 6, pause: float = 6, check=None, sleep=time.sleep) -> Answer:
    """A connector to a local program: for each request a process in a folder of its own, the system text in the variable
    LECTERN_SYSTEM, the prompt on its input; it prints {"result": text, "is_error": false}. A message with a marker of
    ``rules.FATAL_MARKERS`` isn't tried again."""

    def ask(system: str | None, user: str) -> str:
        env = (child_environment() if environment is None else environment) | {"NO_COLOR": "1", "LECTERN_SYSTEM": system or ""}
        with gate(most), tempfile.TemporaryDirectory() as folder:  # the process's own, on the machine where it runs
            done = subprocess.run(command, input=user.encode(), capture_output=True, cwd=folder, env=env, timeout=timeout, check=False)
        said = done.stdout.decode("utf-8", "replace")
        try:
            data = json.loads(said)
        except ValueError:
            data = {"is_error": True, "result": said or done.stderr.decode("utf-8", "replace")}
        if done.returncode or data.get("is_error") or not isinstance(data.get("result"), str):
            message = str(data.get("result"))[:600]
            raise Fatal(message) if is_fatal(message) else RuntimeError(message)
        return data["result"]

    return lambda system, user: with_retries(lambda: ask(system, user), waits(pause, 120, tries), lambda e: not isinstance(e, Fatal), check, sleep)


def route(provider: str, model: str, local: tuple[str, ...], parts: str, prefix: str, prefix_always: bool = True) -> str:
    """Which connector serves: "program" for the local providers; "parts" for that provider, and for models with the prefix
    (always, or only where no provider is named); else "choices"."""
    name = provider.strip().lower()
    if name in local:
        return "program"
    return "parts" if name == parts or ((prefix_always or not name) and model.startswith(prefix)) else "choices"


def terms_resolver(answer: Answer, system: str) -> Callable[[list[dict]], list[dict]]:
    """A resolver of term batches: one request for a batch, answered by a JSON array of en, zh, confidence, alt and note."""

    def resolve(batch: list[dict]) -> list[dict]:
        said = answer(system, json.dumps([{"en": b["en"], "context": b.get("context", "")} for b in batch], ensure_ascii=False, indent=1))
        rows = json.loads(said[said.index("[") : said.rindex("]") + 1])
        clean = lambda r, k: str(r.get(k) or "").strip()
        return [{"en": clean(r, "en"), "zh": clean(r, "zh"), "confidence": clean(r, "confidence").lower(), "alt": clean(r, "alt"), "note": clean(r, "note")} for r in rows if clean(r, "en")]

    return resolve
