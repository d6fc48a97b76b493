"""Commands: `python -m flowmill.cli features IN OUT`, `scale-config IN OUT`, `ddl DEFINITION TABLE`, `schema DEFINITION`."""

from __future__ import annotations

import argparse
import json

from flowmill.plans.registry import load_config, window_settings


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="flowmill", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    features = commands.add_parser("features", help="window features of flow files")
    features.add_argument("source")
    features.add_argument("target")
    features.add_argument("--config")
    config = commands.add_parser("scale-config", help="fit a scaling configuration to a Parquet table")
    config.add_argument("source")
    config.add_argument("target")
    for name in ("ddl", "schema"):
        command = commands.add_parser(name)
        command.add_argument("definition")
        if name == "ddl":
            command.add_argument("table")
    asked = parser.parse_args(arguments)
    if asked.command in ("ddl", "schema"):
        from flowmill.sources import ingest

        definition = load_config(asked.definition)
        if asked.command == "ddl":
            print(ingest.table_ddl(definition, asked.table))
        else:
            from flowmill.session import build_session

            build_session()
            print(ingest.schema_json(definition))
        return
    from flowmill.operators import scaling, windower
    from flowmill.session import build_session
    from flowmill.sources import files

    spark = build_session()
    rows = files.load(spark, asked.source)
    if asked.command == "features":
        settings = window_settings(load_config(asked.config)) if asked.config else windower.Settings()
        files.save(windower.window_features(windower.flow_features(rows, settings.strict_compat), settings), asked.target, "parquet")
    else:
        numeric = [f.name for f in rows.schema if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double")]
        with open(asked.target, "w") as out:
            json.dump(scaling.to_config(scaling.describe(rows, numeric, exact=False)), out, indent=1)


if __name__ == "__main__":
    main()
