"""The configuration's format, stated as a table, and the models made of it. Unknown fields are refused everywhere.

`FORMAT` says which fields each kind of mapping has; `KINDS` says what their values look like; `DEMANDS` says what must hold
between fields of one mapping. Models are built from these three when the module is loaded.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from datetime import date
from functools import cache
from pathlib import PurePath
from typing import Annotated, Any, Literal
from zoneinfo import available_timezones

from pydantic import AfterValidator, BaseModel, ConfigDict, Field, create_model, model_validator

from floodmark.functions import times
from floodmark.functions.keys import KeyPart
from floodmark.plans import cadence
from floodmark.store.tables import TABLES

# The fields of the configuration files, their kinds and their defaults. A field without "=" must be given;
# kind? may be null, [kind] is a list, {kind: kind} a mapping, kind+ isn't empty, a|b is one of those words.
FORMAT = """
Overrides:
  sla_hours            positive? = null
  email_sample_keys    flag? = null
  min_rows_per_load    count? = null
  volume_tolerance_pct positive? = null
  compute_budget_minutes positive? = null
  full_sweep_day       weekday? = null
  settle_minutes       count? = null
  initial_lookback_hours positive? = null
  max_window_hours     positive? = null
EmailServer:
  smtp_host            text? = null
  smtp_port            port = 25
  sender               email? = null
  all_clear_digest     every_run|daily|never = "every_run"
Defaults(Overrides):
  dq_database          name
  environment          text
  timezone             zone
  hmac_secret_file     string? = null
  retention_months     {string: ordinal}
  recipients           {text: [email]+} = {}
  email                EmailServer = {}
  email_sample_keys    flag? = false
  volume_tolerance_pct positive? = 50
  full_sweep_day       weekday? = "SUNDAY"
  settle_minutes       count? = 15
  initial_lookback_hours positive? = 24
  max_window_hours     positive? = 72
  rule_run_at          clock = "06:00"
  rule_weekly_day      weekday? = null
  watchdog_grace_minutes minute = 30
  investigation_retry_days ordinal = 7
  watchdog_owner       text? = null
  compute_budget_scope check|dataset = "check"
  scan_mb_per_minute   positive? = null
Landing:
  roots                [text]+
  file_format          sequence|text|xml|csv|parquet|orc
  file_name_pattern    text = "*"
Cadence:
  kind                 times|interval|calendar_dates|monthly
  times                [clock]? = null
  interval_minutes     ordinal? = null
  dates                [date]? = null
  days_of_month        [monthday]? = null
  timezone             zone
  calendar             EVERYDAY|WEEKDAYS = "EVERYDAY"
Feed(Overrides):
  feed                 name
  expectation_version  ordinal
  pattern              FILE_CYCLIC|FILE_PERIODIC|TABLE_MERGE
  owner                text
  landing              Landing? = null
  cadence              Cadence
  datasets             [name]+
  check_delay_minutes  count = 0
  probes               {name: any} = {}
TimeColumn:
  column               name
  format               text? = null
  granularity          grain? = null
  timezone             zone? = null
WinnerRule:
  order_by             [order]+
  formats              {name: text} = {}
Join:
  dataset              name
  match                {name: name}+
  type                 left|inner = "left"
Derived:
  from                 name
  joins                [Join] = []
  where                fragment? = null
  group_by             {name: fragment}+
  columns              {name: fragment} = {}
Dataset(Overrides):
  dataset              name
  table                table? = null
  derived              Derived? = null
  layer                RAW|CURATED|CDC|GOLD
  upstream             [name] = []
  feed_filter          fragment? = null
  key                  [name]+
  key_normalise        {name: normaliser} = {}
  owner                text? = null
  expectation_version  ordinal? = null
  record_time          TimeColumn? = null
  load_time            TimeColumn? = null
  partition_column     name? = null
  file_name_column     name? = null
  key_unique           flag = false
  group_by             [name] = []
  key_map              {name: {name: name}} = {}
  owned_columns        {name: name} = {}
  mismatch_probe_drop  [name] = []
  hop_exclusions       {name: fragment} = {}
  winner_rule          WinnerRule? = null
Rule:
  rule                 name
  template             max_rows_per_key|max_open_rows_per_key|column_order|superseded_still_open|child_within_parent|value_format|null_rate_max
  dataset              name
  params               {string: any} = {}
  group_by             [name] = []
  owner                text
  status               proposed|approved|retired
  severity             high|medium|low
  frequency            every_run|daily|weekly = "daily"
max_rows_per_key:
  max                  ordinal = 1
max_open_rows_per_key:
  max                  ordinal = 1
  open_when            fragment
column_order:
  lower                name
  upper                name
  nulls_fail           flag = false
  format               text? = null
superseded_still_open:
  group_key            [name]+
  order_column         name
  open_when            fragment
  format               text? = null
child_within_parent:
  parent_dataset       name
  join                 {name: name}+
  child_start          name
  parent_start         name
  parent_end           name
  format               text? = null
value_format:
  column               name
  pattern              regex
null_rate_max:
  column               name
  max_rate             rate
file_exists:
  path                 text? = null
file_value_compare:
  path                 text? = null
  extract_regex        regex? = null
  format               text? = null
  compare_to           partition|window? = null
  confirm_when         later|different = "later"
log_contains:
  path_glob            text? = null
  pattern              regex? = null
table_contains:
  table                table? = null
  condition            fragment? = null
  id                   text? = null
  code_ref             text? = null
"""
TEMPLATES = ("max_rows_per_key", "max_open_rows_per_key", "column_order", "superseded_still_open", "child_within_parent", "value_format", "null_rate_max")
PROBE_NAMES = ("file_exists", "file_value_compare", "log_contains", "table_contains")
#: Of a cadence's kind, the field that it goes by.
GOES_BY = {"times": "times", "interval": "interval_minutes", "calendar_dates": "dates", "monthly": "days_of_month"}


def _like(kind: Any, holds: Callable[[Any], bool], what: str) -> Any:
    def check(value: Any) -> Any:
        if not holds(value):
            raise ValueError(f"{value!r} is no {what}")
        return value

    return Annotated[kind, AfterValidator(check)]


def _text(pattern: str, what: str) -> Any:
    shape = re.compile(pattern)
    return _like(str, lambda v: shape.fullmatch(v) is not None, what)


def _compiles(value: str) -> bool:
    try:
        return bool(value) and re.compile(value) is not None
    except re.error:
        return False


def _normalises(value: Any) -> bool:
    match value:
        case "strip_leading_zeros":
            return True
        case {"parse_date": str(form), **more}:
            return not more and form != "" and "'" not in form
    return False


_zones = cache(available_timezones)

KINDS: dict[str, Any] = {
    "any": Any,
    "string": str,
    "flag": bool,
    "date": date,
    "text": Annotated[str, Field(min_length=1)],
    "name": _text(r"[A-Za-z_][A-Za-z0-9_]*", "identifier"),
    "table": _text(r"[A-Za-z_]\w*\.[A-Za-z_]\w*", "database.table"),
    "clock": _text(r"([01]\d|2[0-3]):[0-5]\d", "24-hour HH:MM"),
    "email": _text(r"[^@\s]+@[^@\s]+\.[^@\s]+", "address"),
    "order": _text(r"\s*[A-Za-z_]\w*(\s+(?i:asc|desc))?\s*", "column ASC or column DESC"),
    "fragment": _like(str, lambda v: ";" not in v, "single expression, as it has a semicolon"),
    "zone": _like(str, lambda v: v in _zones(), "IANA time zone"),
    "regex": _like(str, _compiles, "regular expression"),
    "normaliser": _like(Any, _normalises, "strip_leading_zeros or {parse_date: pattern}"),
    "weekday": Literal["MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY", "SUNDAY"],
    "grain": Literal[times.GRAINS],
    "positive": Annotated[float, Field(gt=0)],
    "rate": Annotated[float, Field(ge=0, le=1)],
    "count": Annotated[int, Field(ge=0)],
    "ordinal": Annotated[int, Field(ge=1)],
    "port": Annotated[int, Field(ge=1, le=65535)],
    "minute": Annotated[int, Field(ge=1, le=59)],
    "monthday": Annotated[int, Field(ge=1, le=31)],
}

# What must hold within one mapping, and what is said where it doesn't.
DEMANDS: dict[str, list[tuple[Callable[[Any], bool], Callable[[Any], str]]]] = {
    "Defaults": [
        (lambda d: d.retention_months.keys() == set(TABLES), lambda d: f"retention_months names each of {', '.join(TABLES)} and nothing else"),
        (lambda d: d.hmac_secret_file is None or PurePath(d.hmac_secret_file).is_absolute(), lambda d: "hmac_secret_file is an absolute path"),
    ],
    "Cadence": [(lambda c: bool(getattr(c, GOES_BY[c.kind])), lambda c: f"a cadence of kind {c.kind} has {GOES_BY[c.kind]}")],
    "Feed": [(lambda f: f.landing is not None or f.pattern == "TABLE_MERGE", lambda f: f"a feed of pattern {f.pattern} has a landing")],
    "Dataset": [(lambda d: (d.table is None) != (d.derived is None), lambda d: "a dataset is either a table or derived")],
}


class Model(BaseModel):
    model_config = ConfigDict(extra="forbid", frozen=True, populate_by_name=True)

    @model_validator(mode="after")
    def _demands(self) -> Model:
        for base in type(self).__mro__:
            for holds, said in DEMANDS.get(base.__name__, ()) if "FORMAT_ENTRY" in vars(base) else ():
                if not holds(self):
                    raise ValueError(said(self))
        return self


class _CadenceMethods(Model):
    def plan(self) -> cadence.Cadence:
        return cadence.Cadence(self.kind, self.timezone, self.times or [], self.interval_minutes, self.dates or [], self.days_of_month or [], self.calendar)


class _TimeColumnMethods(Model):
    def plan(self) -> times.TimeColumn:
        return times.TimeColumn(self.column, self.format, self.granularity, self.timezone)


class _DerivedMethods(Model):
    @property
    def sources(self) -> list[str]:
        return [self.base, *(j.dataset for j in self.joins)]


class _DatasetMethods(Model):
    @model_validator(mode="before")
    @classmethod
    def _derived_times(cls, data: Any) -> Any:
        """A derived dataset's times are those that deriving gives it."""
        if isinstance(data, dict) and data.get("derived") is not None:
            return {"record_time": {"column": "record_ts", "timezone": "UTC"}, "load_time": {"column": "load_ts", "granularity": "minute", "timezone": "UTC"}, **data}
        return data

    def part(self, column: str) -> KeyPart:
        how = self.key_normalise.get(column)
        return KeyPart(column, how == "strip_leading_zeros", how["parse_date"] if isinstance(how, dict) else None)


METHODS: dict[str, type[Model]] = {"Cadence": _CadenceMethods, "TimeColumn": _TimeColumnMethods, "Derived": _DerivedMethods, "Dataset": _DatasetMethods}


def _kind(said: str, models: dict[str, type[Model]]) -> Any:
    """The type that a kind of `FORMAT` stands for."""
    if said.endswith("?"):
        return _kind(said[:-1], models) | None
    if said.endswith("+"):
        return Annotated[_kind(said[:-1], models), Field(min_length=1)]
    if said.startswith("["):
        return list[_kind(said[1:-1], models)]
    if said.startswith("{"):
        key, _, value = said[1:-1].partition(": ")
        return dict[_kind(key, models), _kind(value, models)]
    if "|" in said:
        return Literal[tuple(said.split("|"))]
    return models.get(said) or KINDS[said]


def _built(text: str) -> dict[str, type[Model]]:
    models: dict[str, type[Model]] = {}
    for entry in re.split(r"\n(?=\S)", text.strip()):
        head, *lines = entry.split("\n")
        name, _, base = head.rstrip(":").rstrip(")").partition("(")
        fields: dict[str, Any] = {}
        for line in lines:
            what, _, default = line.partition(" = ")
            field, said = what.split(maxsplit=1)
            kind = _kind(said.strip(), models)
            value: Any = ... if not default else json.loads(default)
            if default and isinstance(kind, type) and issubclass(kind, Model):
                value = kind.model_validate(value)
            fields["base" if field == "from" else field] = (kind, Field(value, alias="from") if field == "from" else value)
        bases = tuple(b for b in (METHODS.get(name), models.get(base)) if b) or (Model,)
        models[name] = create_model(name, __base__=bases, __module__=__name__, **fields)
        models[name].FORMAT_ENTRY = name
    return models


MODELS = _built(FORMAT)
Defaults, Feed, Dataset, Rule, EmailServer = (MODELS[n] for n in ("Defaults", "Feed", "Dataset", "Rule", "EmailServer"))
SETTINGS = tuple(MODELS["Overrides"].model_fields)
PARAMS = {n: MODELS[n] for n in TEMPLATES}
PROBES = {n: MODELS[n] for n in PROBE_NAMES}


def ready(params: Model) -> bool:
    """Every parameter but the labels is set."""
    return all(getattr(params, n) is not None for n in type(params).model_fields if n not in ("id", "code_ref"))
