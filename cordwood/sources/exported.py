"""Exported rows of event channels and providers as lines, and command lines of container logs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAME = re.compile(r"^[A-Za-z0-9][A-Za-z0-9_.\-/]*$")


def event_log_line(time: Column, level: Column, provider: Column, message: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss [Level] Provider: Message."""
    one_line = F.trim(F.regexp_replace(F.coalesce(message, F.lit("")), r"\s*[\r\n]+\s*", " "))
    return F.concat(F.date_format(time, "yyyy-MM-dd HH:mm:ss"), F.lit(" ["), F.coalesce(level, F.lit("Information")), F.lit("] "), F.coalesce(provider, F.lit("")), F.lit(": "), one_line)


def provider_line(time: Column, level: Column, provider: Column, event: Column, payload: Column) -> Column:
    """HH:mm:ss.ffffff [Level] Provider/Event k=v ..."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(payload)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
    return F.rtrim(F.concat(F.date_format(time, "HH:mm:ss.SSSSSS"), F.lit(" ["), level, F.lit("] "), provider, F.lit("/"), event, F.lit(" "), pairs))


def container_command(tool: str, name: str, *, namespace: str | None = None, container: str | None = None, tail: int | None = None, timestamps: bool = False) -> list[str]:
    """The command that follows the logs of a container (docker) or pod (kubectl); names are checked."""
    for part in (name, namespace, container):
        if part is not None and not _NAME.match(part):
            raise ValueError(f"not a name: {part!r}")
    if tool == "docker":
        return ["docker", "logs", "-f", *(["--timestamps"] if timestamps else []), *(["--tail", str(tail)] if tail is not None else []), name]
    if tool == "kubectl":
        return [
            "kubectl", "logs", "-f", *(["-n", namespace] if namespace else []), *(["-c", container] if container else []),
            *(["--timestamps"] if timestamps else []), *([f"--tail={tail}"] if tail is not None else []), name,
        ]
    raise ValueError(f"unknown tool {tool}")


def parse_names(output: str) -> list[str]:
    """Names listed one a line, without blank ones and prefixes such as pod/."""
    return [x.strip().split("/", 1)[-1] for x in output.splitlines() if x.strip()]
