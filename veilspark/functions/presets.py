"""Rule sets for kinds of logs: which rules of the catalogue are on, and rules that a kind needs besides.

A preset is laid over the defaults like a saved rule set: rules that it does not name keep their setting.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from .catalogue import RULES, Rule

@dataclass(frozen=True)
class Preset:
    on: tuple[str, ...] = ()
    off: tuple[str, ...] = ()
    extra: tuple[Rule, ...] = field(default=())
    #: Rules that are blotted out instead of labelled.
    redacted: tuple[str, ...] = ()


def _extra(id: str, pattern: str, gate: tuple[str, ...] = (), on: bool = True, strategy: str = "label") -> Rule:
    return Rule(id, "custom", 50, pattern, gate, None, on, strategy, source="preset")


# Which rules a preset turns on, turns off and blots out.
# The extra rules are written from the makers' own descriptions of the formats.
PRESETS: dict[str, Preset] = {
    # Account ids have 12 digits; resource names are arn:partition:service:region:account:resource.
    "aws-cloudwatch": Preset(
        ("email", "ipv4", "ipv6", "aws_access_key", "aws_secret_key", "url", "hostname", "generic_secret", "session_id", "uuid"),
        ("datetime_iso", "timestamp_unix"),
        (_extra("aws_account_id", r"\b[0-9]{12}\b"), _extra("aws_arn", r"\barn:aws(?:-[a-z]+)*:[a-z0-9-]+:[a-z0-9-]*:(?:[0-9]{12})?:[\w/:.*+=@-]+", ("arn:aws",))),
    ),
    # Combined log format: the last two quoted fields are the page before and the browser.
    "nginx-apache": Preset(
        ("email", "ipv4", "ipv6", "url", "hostname", "bearer_token", "basic_auth", "session_id", "url_credentials"),
        ("datetime_iso", "date_dmy", "date_mdy", "time"),
        (_extra("user_agent", r'"(?:Mozilla|curl|Wget|Opera)/[0-9][^"\n]*"', ('"',), False), _extra("http_referer", r'"https?://[^"\s]+"', ("://",), False)),
    ),
    # Ids are 64 hexadecimal digits or their first 12; a reference is registry/name:tag.
    "docker-k8s": Preset(
        ("email", "ipv4", "ipv6", "hostname", "url", "uuid", "generic_secret", "private_key", "jwt", "bearer_token"),
        (),
        (_extra("container_id", r"\b(?:[0-9a-f]{64}|[0-9a-f]{12})\b"), _extra("k8s_namespace", r'\bnamespaces?["\s]*[=:/]["\s]*[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\b', ("namespace",), False), _extra("docker_image", r"\b[a-z0-9][a-z0-9.-]*(?::[0-9]+)?(?:/[a-z0-9][a-z0-9._-]*)+:[A-Za-z0-9_][\w.-]*", ("/",), False)),
    ),
    "database": Preset(
        ("email", "ipv4", "hostname", "url_credentials", "generic_secret", "credit_card", "ssn", "uuid"),
        (),
        (_extra("db_connection_string", r"""\b(?:mongodb|postgres|mysql|redis)://\S+|\b(?i:server|host|data source)=[^;\s]+;[^\n"']*(?i:password|pwd)=[^;\n"']+""", ("=", "://"), True, "redact"), _extra("sql_values", r"\b(?i:values)\s*\([^()\n]*\)", ("(",), False)),
    ),
    "api-json": Preset(
        ("email", "phone_us", "phone_uk", "phone_intl", "ipv4", "credit_card", "ssn", "jwt", "bearer_token", "generic_secret", "uuid", "gps_coordinates"),
        ("url",),
    ),
    "security-audit": Preset(
        ("email", "phone_us", "phone_uk", "phone_intl", "ipv4", "ipv6", "mac_address", "ssn", "credit_card", "iban", "passport", "drivers_license", "jwt", "bearer_token")
        + ("aws_access_key", "aws_secret_key", "stripe_key", "gcp_api_key", "github_token", "slack_token", "generic_secret", "private_key", "basic_auth", "url_credentials")
        + ("btc_address", "eth_address", "gps_coordinates", "session_id"),
        redacted=("email", "phone_us", "phone_uk", "phone_intl", "ssn", "credit_card", "iban", "passport", "drivers_license", "jwt", "bearer_token")
        + ("aws_access_key", "aws_secret_key", "stripe_key", "gcp_api_key", "github_token", "slack_token", "generic_secret", "private_key", "basic_auth", "url_credentials"),
    ),
    "minimal": Preset(
        ("email", "credit_card", "ssn", "aws_access_key", "aws_secret_key", "private_key"),
        ("ipv4", "ipv6", "hostname", "url", "phone_us", "phone_uk", "phone_intl", "uuid", "jwt", "bearer_token", "generic_secret"),
        redacted=("credit_card", "ssn", "aws_access_key", "aws_secret_key", "private_key"),
    ),
    # OpenSSH prints fingerprints as SHA256 in base64 or MD5 in hexadecimal; PAM names module and service.
    "auth-logs": Preset(
        ("email", "ipv4", "ipv6", "hostname", "mac_address"),
        ("url", "uuid", "datetime_iso", "timestamp_unix"),
        (_extra("unix_username", r"\b(?:user|USER|for|invalid user)[= ]+[a-z_][a-z0-9_-]{0,31}\b"), _extra("ssh_key_fingerprint", r"\bSHA256:[A-Za-z0-9+/]{43}|\bMD5:[0-9a-f]{2}(?::[0-9a-f]{2}){15}\b", ("SHA256:", "MD5:")), _extra("pam_module", r"\bpam_[a-z_]+\([^()\s]+\)", ("pam_",), False)),
    ),
    "sip-voip": Preset(
        ("sip_username", "sip_realm", "sip_nonce", "sip_response", "sip_from_display", "sip_to_display", "sip_contact", "sip_uri", "sip_call_id", "sip_branch", "sip_user_agent", "sip_via")
        + ("ipv4", "ipv6", "phone_us", "phone_uk", "phone_intl", "email", "hostname"),
        ("url", "uuid", "datetime_iso", "timestamp_unix"),
    ),
}


def rules_of(name: str, defaults: list[Rule] = RULES) -> list[Rule]:
    """All rules with the preset laid over them, the preset's own behind."""
    preset = PRESETS[name]
    unknown = {*preset.on, *preset.off} - {r.id for r in defaults}
    if unknown:
        raise ValueError(f"no such rules: {sorted(unknown)}")
    laid = [replace(r, enabled=True) if r.id in preset.on else replace(r, enabled=False) if r.id in preset.off else r for r in defaults]
    return [replace(r, strategy="redact") if r.id in preset.redacted else r for r in laid] + list(preset.extra)


def with_strategy(rules: list[Rule], strategy: str) -> list[Rule]:
    """All rules with one strategy."""
    return [replace(r, strategy=strategy) for r in rules]
