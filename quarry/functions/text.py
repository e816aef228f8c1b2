"""Scalar semantics as column expressions. Lengths of text are code points; limits on bodies are bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TITLE = 255
MAX_SNIPPET = 1000
#: Control, format and line or paragraph separator characters but TAB. The ranges at the end are format characters that
#: older Java versions don't class as such.
UNSAFE = r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}\x{890}\x{891}\x{13439}-\x{1343F}&&[^\t]]"
BLANKS = " \t\n\r\0\x0b"
#: White space as Python's str.split() knows it.
SPACES = r"\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def plain_text(value, limit: int) -> Column:
    """value without unsafe characters, cut to limit code points; null if it is no valid UTF-8."""
    v = _c(value)
    return F.when(F.is_valid_utf8(v), F.substring(F.regexp_replace(v, UNSAFE, ""), 1, limit))


def trimmed(value) -> Column:
    return F.btrim(_c(value), F.lit(BLANKS))


def clamped(value, low: int = 1, high: int = 100) -> Column:
    return F.greatest(F.lit(low), F.least(_c(value), F.lit(high)))


def relative_path(path) -> Column:
    return F.ltrim(F.coalesce(_c(path), F.lit("")), F.lit("/"))


def base_url(url) -> Column:
    """One "/", then one "/index.php", then one "/" off the end, each if it is there."""
    u = F.coalesce(_c(url), F.lit(""))
    for end in ("/", "/index.php", "/"):
        u = F.when(u.endswith(end), F.left(u, F.length(u) - len(end))).otherwise(u)
    return u


def content_url(url, file_id, route: str = "/content/") -> Column:
    return F.concat(base_url(url), F.lit(route), _c(file_id).cast("string"))


def credential(user, secret) -> Column:
    """base64 of user:secret on one line."""
    return F.regexp_replace(F.base64(F.concat(_c(user), F.lit(":"), _c(secret)).cast("binary")), r"[\r\n]", "")


def headers(user, secret, app_id, app_version, version="1.0.0") -> Column:
    """The five headers a content request carries."""
    return F.create_map(F.lit("AA-VERSION"), F.lit(version), F.lit("EX-APP-ID"), _c(app_id), F.lit("EX-APP-VERSION"), _c(app_version), F.lit("AUTHORIZATION-APP-API"), credential(user, secret), F.lit("OCS-APIRequest"), F.lit("true"))


def tls_setting(value) -> Column:
    """'true', 'false' or the path of a certificate bundle. Missing: true."""
    v = F.coalesce(_c(value), F.lit("True"))
    low = F.lower(v)
    return F.when(low.isin("false", "0"), "false").when(low.isin("true", "1"), "true").otherwise(v)


NUMBER = r"^[ \t\n\r\f\x0b]*[+-]?(inf|infinity|nan|([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?)[ \t\n\r\f\x0b]*$"


def timeout_seconds(value, default: float = 90.0) -> Column:
    """Seconds, the default if missing, null (no timeout) if it is no number."""
    v = _c(value)
    number = F.when(F.lower(v).rlike(NUMBER), F.regexp_replace(F.btrim(v, F.lit(" \t\n\r\f\x0b")), "_", "").try_cast("double"))
    return F.when(v.isNull(), F.lit(default)).otherwise(number)


def log_level(value, known=("debug", "info", "warning", "error", "critical")) -> Column:
    v = F.lower(F.regexp_replace(F.coalesce(_c(value), F.lit("info")), f"^[{SPACES}]+|[{SPACES}]+$", ""))
    return F.when(v.isin(*known), v).otherwise("info")


def startup_problem(tunnel_key, port) -> Column:
    """'port' if the port keeps a process without a tunnel from starting, else null."""
    usable = F.coalesce(_c(port), F.lit("")).rlike(r"^\p{Nd}+$")
    return F.when((F.coalesce(_c(tunnel_key), F.lit("")) == "") & ~usable, "port")


def binding(tunnel_key, socket, host, port) -> Column:
    at_socket = F.concat(F.lit("unix socket "), F.coalesce(_c(socket), F.lit("/tmp/app.sock")), F.lit(" (tunnel)"))
    at_port = F.concat(F.lit("tcp "), F.coalesce(_c(host), F.lit("127.0.0.1")), F.lit(":"), F.coalesce(_c(port), F.lit("unset")))
    return F.when(F.coalesce(_c(tunnel_key), F.lit("")) != "", at_socket).otherwise(at_port)


def identity(user) -> Column:
    return F.nullif(_c(user), F.lit(""))


def provider_order(route) -> Column:
    return F.when(F.coalesce(_c(route), F.lit("")).startswith("files."), -5).otherwise(25)


def result_url(file_id, index: str = "/files", show: str = "/f/") -> Column:
    i = _c(file_id)
    return F.when(i <= 0, F.lit(index)).otherwise(F.concat(F.lit(show), i.cast("string")))


def epoch_seconds(ts) -> Column:
    """Whole seconds of a time without zone, read as UTC whatever the session's zone."""
    t = _c(ts)
    return F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def iso_seconds(ts) -> Column:
    s = _c(ts).cast("string")
    return F.concat(F.left(s, F.lit(10)), F.lit("T"), F.substring(s, 12, 8), F.lit("+00:00"))


#: What the bytes 0x80 to 0x9F mean in Windows-1252, where they differ from Latin-1; the five unused ones stay.
CP1252_HIGH = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"


def detected_text(content) -> Column:
    """Bytes as UTF-8 if they are valid, else as Windows-1252."""
    c = _c(content)
    latin = F.translate(F.decode(c, "iso-8859-1"), "".join(map(chr, range(0x80, 0xA0))), CP1252_HIGH)
    as_text = c.cast("string")
    return F.when(F.is_valid_utf8(as_text), as_text).otherwise(latin)
