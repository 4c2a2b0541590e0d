"""Words of the language that the semantic model knows."""

#: The keywords of the language's model.
KEYWORDS = (
    "for", "each", "endfor", "if", "elseif", "else", "endif", "do", "case", "otherwise", "endcase", "sub", "endsub", "where", "defined", "by", "order", "parm", "in", "out", "inout", "not", "and", "or",
    "like", "true", "false", "nullvalue", "new", "is",
)
#: A block's opening and closing statement.
BLOCKS = {"ForEach": "EndFor", "If": "EndIf", "DoCase": "EndCase", "Sub": "EndSub"}
CONDITIONS = ("If", "ElseIf", "Case", "Where")
