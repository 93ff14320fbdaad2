"""Command line: python -m logtide -i INPUT [-o OUTPUT] [-r FORMATS] [-t FIELD] [-q] [-m] [-p]"""

from __future__ import annotations

import argparse
import sys

from .config import Settings, builtin_formats, user_formats


def main(argv: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(prog="logtide", description="Validity and completeness of logs.")
    one = a.add_mutually_exclusive_group(required=True)
    one.add_argument("-i", "--input", help="a file, or a folder with all below it")
    one.add_argument("-p", "--printregexes", action="store_true", help="print the built-in timestamp formats")
    a.add_argument("-o", "--output", default="logtide_output")
    a.add_argument("-r", "--regexes", help="YAML file of timestamp formats to use instead")
    a.add_argument("-t", "--tf", help="the field that holds the timestamp (a->b in JSON)")
    a.add_argument("-q", "--quick", action="store_true", help="no hashes, duplicates and redactions")
    a.add_argument("-m", "--multipart", action="store_true", help="all files are parts of one log")
    a.add_argument("-v", "--verbose", action="store_true", help="list the files and what was found in each")
    o = a.parse_args(argv)
    if o.printregexes:
        for f in builtin_formats():
            print(f"- pretty_format: {f.name!r}\n  regex: {f.regex!r}\n  strftime_format: {f.strftime!r}")
        return 0

    from .operators.alerts import alert_rollup, alert_rows
    from .operators.profile import top_gaps
    from .plans import analyze, sinks
    from .session import session

    spark = session()
    formats = user_formats(o.regexes) if o.regexes else builtin_formats()
    run = analyze.analyze(spark, Settings(o.input, o.output, o.tf, formats, o.quick, o.multipart))
    sinks.write_all(run, o.output)
    if o.verbose:
        run.stats.select("file_path", "log_type", "column", "n_records", "n_ts", "n_errors", "one_error").orderBy("file_path").show(truncate=False)
    if o.multipart:
        m = analyze.merged(run)
        m.drop("alerts").show(truncate=False)
        alert_rollup(analyze.merged_alerts(run, m)).show(truncate=False)
    else:
        top_gaps(run.stats, "file_path").select("file_name", "min_ts", "max_ts", "ltg_begin", "ltg_end").show(truncate=False)
        alert_rollup(alert_rows(run.stats, "file_path")).show(truncate=False)
    analyze.summary(run).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
