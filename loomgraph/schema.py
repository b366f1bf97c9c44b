"""The graph's fixed envelope: node and edge structs, kinds, and what each column means.

Attributes are dynamic: a map from name to the value's JSON text, so equality of attributes is equality of text.
"""

from __future__ import annotations

# The kinds of nodes and edges.
NODE_KINDS = ("Workspace", "Project", "Package", "Assembly", "Namespace", "Type", "Method", "HttpEndpoint", "HttpCallSite", "ExternalRef")
EDGE_KINDS = ("Contains", "References", "DependsOn", "Implements", "Inherits", "Calls", "Uses", "HandlesRoute", "CallsRoute", "DescribedBy")
#: Edges that count as a use of their target.
USAGE_KINDS = ("Calls", "Uses", "Implements")

# The characters that count as white space around identifiers and names.
WHITE = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

SPAN_DDL = "struct<start_line:int,start_col:int,end_line:int,end_col:int>"
REFS_DDL = "array<struct<file:string,spans:array<struct<start_line:int,start_col:int,end_line:int,end_col:int>>>>"
NODE_DDL = f"workspace string, id string, kind string, fqn string, version string, display_name string, attributes map<string,string>, source_refs {REFS_DDL}"
EDGE_DDL = f"workspace string, from_id string, to_id string, kind string, attributes map<string,string>, source_refs {REFS_DDL}"
