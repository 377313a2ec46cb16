"""Session, catalog, privilege and sequence functions: evaluated on the driver and spliced in as constants."""

from __future__ import annotations

import itertools
import threading

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .registry import col, function


class Settings:
    """A session's settings and sequences."""

    def __init__(self):
        self.values: dict[str, str] = {"search_path": '"$user", public', "timezone": "UTC", "default_text_search_config": "english"}
        self.sequences: dict[str, dict] = {}
        self.last: str | None = None
        self.lock = threading.Lock()

    def create_sequence(self, name: str, start: int = 1, step: int = 1) -> None:
        self.sequences[name] = {"next": start, "step": step, "value": None}

    def nextval(self, name: str) -> int:
        with self.lock:
            s = self.sequences[name]
            s["value"], s["next"] = s["next"], s["next"] + s["step"]
            self.last = name
            return s["value"]

    def reserve(self, name: str, n: int) -> range:
        """n values in one step, for the rows of a bulk insert."""
        with self.lock:
            s = self.sequences[name]
            first, s["next"] = s["next"], s["next"] + n * s["step"]
            return range(first, s["next"], s["step"])


SETTINGS = Settings()
PRIVILEGES = ("any_column", "column", "database", "foreign_data_wrapper", "function", "schema", "sequence", "server", "table", "tablespace", "type")


@function("current_database")
def current_database() -> Column:
    return F.current_database()


@function("current_schema")
def current_schema() -> Column:
    """Spark's default database is the public schema."""
    own = F.call_function("current_schema")
    return F.when(own == "default", "public").otherwise(own)


@function("current_schemas")
def current_schemas(implicit: bool = False) -> Column:
    return F.array(F.lit("pg_catalog"), current_schema()) if implicit else F.array(current_schema())


@function("current_user", "user")
def current_user() -> Column:
    return F.current_user()


@function("session_user")
def session_user() -> Column:
    return F.session_user()


@function("version")
def version() -> Column:
    return F.version()


@function("current_setting")
def current_setting(name: str, missing_ok: bool = False) -> Column:
    spark = SparkSession.getActiveSession()
    value = SETTINGS.values.get(name.lower()) or (spark.conf.get(name, None) if spark and "." in name else None)
    if value is None and not missing_ok:
        raise LookupError(f"unrecognized configuration parameter {name}")
    return F.lit(value)


@function("set_config")
def set_config(name: str, value: str, local: bool = False) -> Column:
    SETTINGS.values[name.lower()] = value
    return F.lit(value)


@function("get_current_ts_config")
def get_current_ts_config() -> Column:
    return F.lit(SETTINGS.values["default_text_search_config"])


@function("nextval")
def nextval(name: str) -> Column:
    return F.lit(SETTINGS.nextval(name)).cast("bigint")


@function("currval")
def currval(name: str) -> Column:
    value = SETTINGS.sequences[name]["value"]
    if value is None:
        raise LookupError(f"currval of sequence {name} is not yet defined in this session")
    return F.lit(value).cast("bigint")


@function("lastval")
def lastval() -> Column:
    if SETTINGS.last is None:
        raise LookupError("lastval is not yet defined in this session")
    return currval(SETTINGS.last)


@function("setval")
def setval(name: str, value: int, called: bool = True) -> Column:
    s = SETTINGS.sequences[name]
    s["value"], s["next"] = value, value + s["step"] if called else value
    return F.lit(value).cast("bigint")


@function("unique_rowid")
def unique_rowid() -> Column:
    return F.monotonically_increasing_id()


@function("gen_random_uuid", "uuid_generate_v4")
def gen_random_uuid() -> Column:
    return F.uuid()


@function("pg_notify")
def pg_notify(channel: str, payload: str) -> Column:
    """No listeners in a batch engine: an empty text."""
    return F.lit("")


@function("pg_is_in_recovery")
def pg_is_in_recovery() -> Column:
    return F.lit(False)


@function("pg_get_serial_sequence")
def pg_get_serial_sequence(table: str, column: str) -> Column:
    name = f"{table}_{column}_seq"
    return F.lit(f"public.{name}" if name in SETTINGS.sequences else None).cast("string")


def _privilege(kind: str):
    @function(f"has_{kind}_privilege")
    def build(*args) -> Column:
        """One role owns everything here."""
        return F.lit(True)

    return build


for _kind in PRIVILEGES:
    _privilege(_kind)


@function("pg_has_role")
def pg_has_role(*args) -> Column:
    return F.lit(True)


_OIDS = itertools.count(16_384)
_KNOWN: dict[str, int] = {}


def oid(name: str) -> int:
    """A number for a name, the same throughout a session."""
    return _KNOWN.setdefault(name, next(_OIDS))


def _relation(exists):
    def build(name: str) -> Column:
        return F.lit(oid(name) if exists(name) else None).cast("bigint")

    return build


def _table_exists(name: str) -> bool:
    spark = SparkSession.getActiveSession()
    return spark is not None and spark.catalog.tableExists(name)


def _function_exists(name: str) -> bool:
    from .registry import FUNCTIONS

    return name.split("(")[0] in FUNCTIONS


def _schema_exists(name: str) -> bool:
    spark = SparkSession.getActiveSession()
    return spark is not None and spark.catalog.databaseExists(name)


for _name, _exists in (("to_regclass", _table_exists), ("to_regnamespace", _schema_exists), ("to_regproc", _function_exists), ("to_regprocedure", _function_exists), ("to_regrole", lambda n: True)):
    function(_name)(_relation(_exists))


@function("pg_options_to_table")
def pg_options_to_table(options) -> Column:
    """Rows of option_name, option_value of texts a=b."""
    pairs = F.transform(col(options), lambda o: F.struct(F.split_part(o, F.lit("="), F.lit(1)).alias("option_name"), F.substr(o, F.instr(o, F.lit("=")) + 1).alias("option_value")))
    return F.inline(pairs)


@function("pg_typeof")
def pg_typeof(x) -> Column:
    names = {"bigint": "bigint", "int": "integer", "string": "text", "double": "double precision", "float": "real", "boolean": "boolean", "date": "date", "timestamp": "timestamp with time zone", "timestamp_ntz": "timestamp without time zone", "binary": "bytea"}
    out = F.typeof(col(x))
    for spark_name, name in names.items():
        out = F.when(F.typeof(col(x)) == spark_name, F.lit(name)).otherwise(out)
    return out
