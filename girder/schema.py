"""Schemas of the fact tables and of the JSON documents that are read."""

from __future__ import annotations

FACTS = (
    "specifiers array<string>, "
    "bindings array<struct<specifier:string,bind_ord:int,symbol:string,kind:string,local:string>>, "
    "member_sites array<struct<site_ord:int,subject:string,name:string,in_decl:string,declares:string>>, "
    "export_sites array<struct<site_ord:int,name:string,kind:string,declares:string,reexport:boolean>>"
)
FILES = "path string, dir string, base string, ext string, text string"
DIAGNOSTICS = "file string, line int, col int, code string, message string"
LEDGER = (
    "version int, kind string, created string, "
    "sectors map<string,struct<entered:string,initial:double,cleared:double,closed:double,lastCleared:string,holdouts:array<string>>>, "
    "concessions array<struct<sector:string,at:string,by:string,delta:double,`from`:double,`to`:double,reason:string,holdouts:array<string>>>"
)
BASELINE = "version int, entries array<string>"
