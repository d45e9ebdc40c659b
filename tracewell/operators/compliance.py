"""Compliance controls by CWE number."""

# The controls that each CWE number maps to.
FRAMEWORKS = ("OWASP Top 10", "PCI-DSS v4.0", "SOC 2", "ISO 27001", "HIPAA")
CONTROLS: dict[str, tuple[str | None, ...]] = {
    "89": ("A03:2021-Injection", "Requirement 6.2.4", "CC7.1", "A.8.28", "164.306(a)"),
    "78": ("A03:2021-Injection", "Requirement 6.2.4", "CC7.1", "A.8.28", "164.306(a)"),
    "79": ("A03:2021-Injection", "Requirement 6.2.4", "CC7.1", "A.8.28", None),
    "798": ("A02:2021-Cryptographic Failures", "Requirement 8.2", "CC6.1", "A.8.20", "164.312(a)(2)(iv)"),
    "22": ("A01:2021-Broken Access Control", "Requirement 6.2.4", "CC6.1", "A.8.28", None),
    "918": ("A10:2021-Server-Side Request Forgery", "Requirement 6.2.4", "CC7.1", "A.8.28", None),
    "502": ("A08:2021-Software and Data Integrity Failures", "Requirement 6.2.4", "CC7.1", "A.8.28", None),
    "90": ("A03:2021-Injection", "Requirement 6.2.4", "CC7.1", "A.8.28", None),
    "643": ("A03:2021-Injection", "Requirement 6.2.4", "CC7.1", "A.8.28", None),
    "943": ("A03:2021-Injection", "Requirement 6.2.4", "CC7.1", "A.8.28", None),
    "601": ("A01:2021-Broken Access Control", "Requirement 6.2.4", "CC6.1", "A.8.28", None),
    "327": ("A02:2021-Cryptographic Failures", "Requirement 6.2.1", "CC6.1", "A.8.24", "164.312(a)(2)(iv)"),
    "338": ("A02:2021-Cryptographic Failures", "Requirement 6.2.1", "CC6.1", "A.8.24", None),
    "287": ("A07:2021-Identification and Authentication Failures", "Requirement 8.1", "CC6.1", "A.8.5", "164.312(a)(1)"),
    "942": ("A05:2021-Security Misconfiguration", "Requirement 2.2", "CC6.3", "A.8.9", "164.308(a)(1)(ii)"),
}


def rows() -> list[tuple[str, str, str]]:
    """(cwe, framework, control)."""
    return [(cwe, name, control) for cwe, controls in CONTROLS.items() for name, control in zip(FRAMEWORKS, controls, strict=True) if control]
