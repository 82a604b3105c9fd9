"""python -m quire COMMAND ..."""

from __future__ import annotations

import json
import sys
from pathlib import Path

from . import api
from .operators import frames

USAGE = """python -m quire
  hwp:txt IN | hwp:md IN | txt IN | md IN [--embed] | html IN | inspect IN
  html:tpl IN DATA.json
  md:hwpx IN OUT [TITLE] | html:hwpx IN OUT [TITLE] | convert:hwp IN OUT | write:txt OUT TEXT [TITLE]
  batch FOLDER OUT | batch:tpl FOLDER DATA_FOLDER OUT"""


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("quire").getOrCreate()


def _by_suffix(path: str) -> str:
    return "hwp" if path.lower().endswith(".hwp") else "hwpx"


def main(argv: list[str]) -> int:
    if not argv:
        print(USAGE)
        return 1
    command, rest = argv[0], [a for a in argv[1:] if not a.startswith("--")]
    embed = "--embed" in argv
    raw = lambda k=0: Path(rest[k]).read_bytes()
    title = lambda k: rest[k] if len(rest) > k else ""
    try:
        if command == "hwp:txt":
            print(api.hwp_to_text(raw()))
        elif command == "hwp:md":
            print(api.hwp_to_markdown(raw(), embed))
        elif command == "txt":
            print(frames.to_text(_by_suffix(rest[0]), raw()))
        elif command == "md":
            print(frames.to_markdown(_by_suffix(rest[0]), raw(), embed))
        elif command == "html":
            print(api.hwpx_to_html(raw(), embed=True))
        elif command == "inspect":
            print(json.dumps(api.inspect(raw()), indent=2, ensure_ascii=False))
        elif command == "html:tpl":
            filled = api.fill(api.hwpx_to_text(raw()), json.loads(Path(rest[1]).read_text()))
            import re

            print("".join(f"<p>{api.package.escape_html(x)}</p>" for x in re.split("\n+", filled)))
        elif command == "md:hwpx":
            Path(rest[1]).write_bytes(api.markdown_to_hwpx(raw().decode(), title(2)))
        elif command == "html:hwpx":
            Path(rest[1]).write_bytes(api.html_to_hwpx(raw().decode(), title(2)))
        elif command == "convert:hwp":
            Path(rest[1]).write_bytes(api.hwp_to_hwpx(raw()))
        elif command == "write:txt":
            Path(rest[0]).write_bytes(api.text_to_hwpx(rest[1], title(2)))
        elif command == "batch":
            api.write_named(api.batch_html(_spark(), rest[0]), "html", rest[1], ".html")
        elif command == "batch:tpl":
            api.write_named(api.batch_templates(_spark(), rest[0], rest[1]), "html", rest[2], ".html")
        else:
            print(USAGE)
            return 1
    except (IndexError, OSError, api.DocumentError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
