"""Shapes, as DDL, of the tables that make up a graph and its logs."""

from __future__ import annotations

NODE = "id string, kind string, name string, source_file string, source_location string, is_method boolean, anonymous boolean, community int"
EDGE = "source string, target string, relation string, relations array<string>, source_file string, source_location string, context string, confidence string, weight double"
FILE = "rel_path string, language string, size long, content_hash string"
CLUSTER = "id int, members array<string>, size int, file_count int, function_count int, class_count int, labels array<string>"
BUNDLE = f"nodes array<struct<{NODE}>>, edges array<struct<{EDGE}>>, clusters array<struct<{CLUSTER}>>, metadata map<string, string>"
USAGE = "ts string, cmd string, wall_ms long, output_bytes long, files array<struct<path string, bytes long>>"
INCIDENT = "schema int, kind string, fingerprint string, ts string, class string, code string, subject string, detail string, note string"

PROJECT_KINDS = ("file", "function", "class")
