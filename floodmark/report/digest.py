"""The digest: for each owner, what fails and since when and why, what recovered, what didn't run, in plain text."""

from __future__ import annotations

import smtplib
from collections import defaultdict
from dataclasses import dataclass, field
from datetime import datetime
from email.message import EmailMessage
from zoneinfo import ZoneInfo

from floodmark.config.loader import Config
from floodmark.config.models import EmailServer
from floodmark.functions.times import as_utc


@dataclass(frozen=True)
class Item:
    dataset: str
    check_id: str
    groups: str
    state: str
    previous: str | None = None
    failed_since: datetime | None = None
    observed: str | None = None
    expected: str | None = None
    reason: str | None = None
    population: int | None = None
    violations: int | None = None
    severity: str | None = None
    proposed: bool = False
    causes: tuple[str, ...] = ()
    samples: tuple[str, ...] = ()
    slots: tuple[str, ...] = ()


@dataclass
class Digest:
    owner: str
    failing: list[Item] = field(default_factory=list)
    proposed: list[Item] = field(default_factory=list)
    recovered: list[Item] = field(default_factory=list)
    not_run: list[Item] = field(default_factory=list)
    gone: list[Item] = field(default_factory=list)
    passed: int = 0

    @property
    def all_clear(self) -> bool:
        return not (self.failing or self.not_run)


def merged(items: list[Item]) -> list[Item]:
    """A slot that brought no load is late and empty at once: such a ZERO_ROWS item goes if each of its slots is late too."""
    late = {(i.dataset, i.groups): set(i.slots) for i in items if i.check_id == "T1_ON_TIME"}
    return [i for i in items if not (i.check_id == "T1_ZERO_ROWS" and i.slots and set(i.slots) <= late.get((i.dataset, i.groups), set()))]


def build(config: Config, items: list[Item], gone: list[Item] = ()) -> list[Digest]:
    """One digest for each owner of a dataset or rule that has items."""
    out: dict[str, Digest] = {}

    def of(i: Item) -> Digest:
        rule = config.rules.get(i.check_id)
        owner = rule.owner if rule else config.owner(i.dataset)
        return out.setdefault(owner, Digest(owner))

    by = defaultdict(list)
    for i in items:
        by[i.state].append(i)
    for i in merged(by["FAILED"]):
        (of(i).proposed if i.proposed else of(i).failing).append(i)
    for i in by["DID_NOT_RUN"]:
        if i.reason != "insufficient_history":
            of(i).not_run.append(i)
    for i in by["PASSED"]:
        d = of(i)
        d.passed += 1
        if i.previous == "FAILED":
            d.recovered.append(i)
    for i in gone:
        of(i).gone.append(i)
    return [out[o] for o in sorted(out)]


def due(policy: str, digest: Digest, now: datetime, run_at: str, zone: str) -> bool:
    """An all-clear goes out every run, once a day in the hour of run_at, or never; anything else always."""
    if not digest.all_clear or policy == "every_run":
        return True
    return policy == "daily" and as_utc(now).astimezone(ZoneInfo(zone)).hour == int(run_at[:2])


def _line(i: Item) -> list[str]:
    name = f"{i.dataset} / {i.check_id}" + (f" [{i.groups}]" if i.groups else "") + (f" ({i.severity})" if i.severity else "")
    since = f" since {as_utc(i.failed_since):%Y-%m-%d %H:%M} UTC" if i.failed_since else ""
    out = [f"- {name}{since}"]
    if i.observed:
        out.append(f"    found {i.observed}; expected {i.expected}")
    if i.reason:
        out.append(f"    reason {i.reason}")
    out += [f"    cause {c}" for c in i.causes] + [f"    for example {s}" for s in i.samples]
    return out


def text(d: Digest, environment: str, run_id: str) -> str:
    out = [f"Data checks for {d.owner}, {environment}, run {run_id}", ""]
    for title, items in (("Failing", d.failing), ("Failing proposed rules, for information", d.proposed), ("Did not run", d.not_run), ("Recovered", d.recovered), ("Groups no longer there", d.gone)):
        if items:
            out += [f"{title}: {len(items)}"] + [x for i in sorted(items, key=lambda i: (i.dataset, i.check_id, i.groups)) for x in _line(i)] + [""]
    return "\n".join([*out, f"Passed: {d.passed}", ""])


def send(server: EmailServer, to: list[str], subject: str, body: str) -> str:
    """What became of it. Mail never stops a run."""
    if not server.smtp_host or not server.sender:
        return "not sent: no mail server is set"
    try:
        message = EmailMessage()
        message["From"], message["To"], message["Subject"] = server.sender, ", ".join(to), subject
        message.set_content(body)
        with smtplib.SMTP(server.smtp_host, server.smtp_port, timeout=30) as smtp:
            smtp.send_message(message)
    except Exception as e:  # noqa: BLE001
        return f"not sent: {type(e).__name__}"
    return f"sent to {len(to)}"
