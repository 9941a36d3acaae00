"""Column types of the engine."""

from __future__ import annotations

MEASURE = "struct<unit:string,value:double,upper_value:double,num:bigint,den:bigint,upper_num:bigint,upper_den:bigint>"
MEASURES = f"array<{MEASURE}>"
NOTES = "struct<confidence:string,fell_back:boolean,unparsed_digit:boolean>"
INGREDIENT = f"struct<name:string,amounts:{MEASURES},modifier:string,optional:boolean,usage:string,parse_notes:{NOTES}>"
CHUNKS = f"array<struct<kind:string,text:string,measures:{MEASURES}>>"
SPANS = "struct<source:string,spans:array<struct<field:string,start:int,end:int,text:string>>>"
CLAUSES = "array<struct<start:int,end:int,sep:string,kind:string,parens:array<string>,stripped:string>>"
MAPPING = f"struct<a:{MEASURE},b:{MEASURE},source:string,error:string>"
YIELD = "struct<value:double,unit:string,servings:int>"
