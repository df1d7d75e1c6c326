"""Small grammars over token classes, one per language: which classes may be adjacent, and which texts follow a production.

A token class is one letter. Grammars are productions over letters and other productions; which class may stand next to which
follows from them (the last classes of a part times the first classes of what can come next).
"""

from __future__ import annotations

import re
from functools import lru_cache

LANGUAGES = {".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".go": "go", ".c": "c"}

#: Class of each reserved word, by language (fixed values). n is a name, 0 a number, s a text, r a regular expression.
_WORDS = {
    "javascript": {"K": "if while for switch catch with", "E": "else try finally do", "R": "return throw", "W": "new typeof delete void await yield", "B": "break continue debugger", "V": "var let", "c": "const", "F": "function", "C": "class", "I": "import export", "D": "case", "L": "default", "O": "in of instanceof", "A": "async static get set", "M": "from as", "x": "extends"},
    "java": {"K": "if while for switch catch", "E": "else try finally do", "R": "return throw assert", "W": "new", "B": "break continue", "C": "class interface enum", "I": "import package", "D": "case", "L": "default", "O": "instanceof", "A": "public private protected static final abstract native synchronized transient volatile strictfp", "x": "extends implements throws"},
    "go": {"K": "for switch select", "Y": "if", "E": "else", "R": "return defer go goto", "B": "break continue fallthrough", "V": "var const type", "F": "func", "I": "import package", "D": "case", "L": "default", "A": "chan map struct interface range"},
    "c": {"K": "if while for switch", "E": "else do", "R": "return goto", "W": "sizeof", "B": "break continue", "D": "case", "L": "default", "A": "static const extern inline unsigned signed volatile register typedef struct union enum long short restrict"},
    "python": {"k": "if elif while with", "z": "for", "0": "None True False", "p": "except", "E": "else finally", "y": "try", "R": "return raise", "g": "del global nonlocal", "j": "assert", "W": "await yield", "B": "break continue pass", "F": "def", "C": "class", "I": "import", "M": "from", "l": "lambda", "O": "in is and or", "u": "not", "A": "async", "S": "as"},
}
_WORDS["typescript"] = _WORDS["javascript"] | {"A": "async static get set type interface enum namespace declare abstract readonly public private protected keyof is asserts satisfies infer unique override module", "x": "extends implements"}

#: Class of each operator (fixed values): = assigns, o stands between operands, b between or before, u before, i before or behind, a is an arrow, e an ellipsis.
_SIGNS = {
    "=": "= += -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??= := &^= //= @=",
    "o": "== === != !== <= >= < > && || | ^ / % ** ?? << >> >>> // <>",
    "b": "+ - & *",
    "u": "! ~",
    "i": "++ --",
    "a": "=> -> <-",
    "e": "...",
}
_PLAIN = "()[]{},;.:?@"

_STRING = r'"(?:\\[\s\S]|[^"\\\n\r])*"'
_CHAR = r"'(?:\\[\s\S]|[^'\\\n\r])*'"
_NUMBER = r"(?:0[xXbBoO][\da-fA-F_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[nNlLuUfFdDjJi]*(?![\w$])"
_NAME = r"[^\W\d][\w$]*|\$[\w$]*"
_SIGN = r">>>=|\*\*=|\.\.\.|===|!==|<<=|>>=|>>>|&&=|\|\|=|\?\?=|&\^=|\?\.(?!\d)|=>|->|<-|:=|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*"
_C_SKIP = r"[ \t\f\v ﻿]+|//[^\n\r]*|/\*[\s\S]*?\*/"
_REGEX = r"(?:[=(,:\[!&|?{};]\s*|\b(?:return|typeof|case|throw|yield|await|in|of)[ \t]*)/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[dgimsuvy]*"
_TOKENS = {
    "javascript": (_C_SKIP, rf"{_REGEX}|{_STRING}|{_CHAR}|`(?:\\[\s\S]|[^`\\])*`|{_NUMBER}|#?(?:{_NAME})|{_SIGN}"),
    "java": (_C_SKIP, rf'"""[\s\S]*?"""|{_STRING}|\'(?:\\u+[\da-fA-F]{{4}}|\\[0-7]{{1,3}}|\\.|[^\'\\\n])\'|{_NUMBER}|{_NAME}|::|{_SIGN}'),
    "go": (_C_SKIP, rf"{_STRING}|`[^`]*`|'(?:\\[xuU0-7][\da-fA-F]*|\\.|[^'\\\n])'|{_NUMBER}|{_NAME}|{_SIGN}"),
    "c": (_C_SKIP + r"|\\\r?\n", rf"(?:^|(?<=\n))[ \t]*#[ \t]*(?:include|define|undef|ifdef|ifndef|if|elif|else|endif|pragma|error|line|warning)\b(?:\\\r?\n|/\*[\s\S]*?\*/|[^\n\r])*|(?:L|u8?|U)?{_STRING}|(?:L|u|U)?{_CHAR}|{_NUMBER}|{_NAME}|{_SIGN}"),
}
_TOKENS["typescript"] = _TOKENS["javascript"]
_PREFIX = r"(?:[rRbBfFuUtT]{1,2})?"
_PY_SKIP = r"[ \t\f﻿]+|#[^\n\r]*|\\\r?\n|(?:\r\n|\r|\n)(?=[ \t\f]*(?:[\r\n#]|\Z))"
_PY_TOKEN = rf'{_PREFIX}"""(?:\\[\s\S]|[^\\])*?"""|{_PREFIX}\'\'\'(?:\\[\s\S]|[^\\])*?\'\'\'|{_PREFIX}{_STRING}|{_PREFIX}{_CHAR}|{_NUMBER}|[^\W\d]\w*|(?:\r\n|\r|\n)[ \t]*|\*\*=|//=|>>=|<<=|\.\.\.|:=|->|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|<<|>>|\*\*|//'
#: Numbers that Python no longer has.
_ODD_NUMBER = re.compile(r"0\d*[1-9]\d*|.*[lLuUfFdDiI]|.*__.*|.*_")
INDENT_BASE = 0x4E00  # a line end is the letter INDENT_BASE + its indentation

# --- productions: (...)* repeated, (...)? optional, upper names are productions ----------------------------------------------
# Brackets are reduced before: P stands for a closed pair of round ones, Q of square ones, G of curly ones, and what they hold is a text of its own, held
# against the production that the bracket's place asks for (``start_of``). So no production needs brackets, and nesting has no bound.
_EXPR = {
    "Exprs": ["Expr (, Expr)*"],
    "Expr": ["Unary (Bin Unary)* (? Expr : Expr)?"],
    "Bin": ["o", "b", "O", "="],
    "Unary": ["(Pre)* Atom (Tail)* (i)?"],
    "Pre": ["b", "u", "i", "W"],
    "Tail": [". n", "P", "Q"],
    "List": ["Item (, Item)* (,)?"],
    "Item": ["Expr"],
}
_JS = _EXPR | {
    "Top": ["Unit"],
    "Unit": ["(Stmt)* (Open)?"],
    "Stmt": ["Open ;", ";", "G", "Func", "Cls", "K P Stmt", "K W P Stmt", "K P Open", "K G", "E Stmt", "D Exprs :", "D Exprs : G", "L :", "L : G", "n : Stmt", "Export Func", "Export Cls", "I L Func", "I L Cls"],
    "Open": ["Exprs", "V Bind (, Bind)*", "c Bound (, Bound)*", "R (Exprs)?", "B (n)?", "E Open", "I Import", "Export Open", "I L Expr", "I G (M s)?", "I b (M n)? M s", "I G (O G)?"],
    "Export": ["I"],
    "Import": ["s", "n M s", "G M s", "b M n M s", "n , G M s", "n , b M n M s", "P (Tail)*"],
    "Bind": ["Pattern (= Expr)?"],
    "Bound": ["Pattern = Expr"],
    "Pattern": ["Name", "Q", "G"],
    "Name": ["n", "A", "M"],
    "Head": ["Exprs", "(Init)? ; (Exprs)? ; (Exprs)?", "(Decl)? Pattern O Exprs", "Expr O Exprs"],
    "Decl": ["V", "c"],
    "Init": ["Exprs", "V Bind (, Bind)*", "c Bound (, Bound)*"],
    "Func": ["(A)? F (b)? (Name)? P G"],
    "Cls": ["C (Name)? (x Unary)? G"],
    "Body": ["(Member)*", "(Member)* (A)* Key = Expr", "(Member)* (A)* Key"],
    "Member": ["(A)* (b)? Key P G (;)?", "(A)* Key (= Expr)? ;", "A G", ";"],
    "Key": ["n", "s", "0", "Q", "A", "M", "K", "E", "R", "W", "B", "V", "c", "F", "C", "I", "D", "L", "O", "x"],
    "Paren": ["(List)?"],
    "Square": ["(, )* (Item (, )* )* (Item)?", "(Cell)* (Item)?"],
    "Cell": ["Item ,", ","],
    "Elems": ["(Prop (, Prop)* (,)?)?", "NameAs (, NameAs)* (,)?"],
    "NameAs": ["n (M n)?", "L M n", "n M L"],
    "Prop": ["Key : Expr", "Name (= Expr)?", "e Expr", "(A)* (b)? Key P G"],
    "Item": ["Expr", "e Expr"],
    "Atom": ["Name", "0", "s (s)*", "r", "P", "Q", "G", "Func", "Cls", "Arrow", "I P", "I . n", "W"],
    "Arrow": ["(A)? Name a Expr", "(A)? P a Expr", "A P a Expr"],
    "Tail": [". n", "P", "Q", "s", "? . n", "? . P", "? . Q"],
}
_TS = {
    "Top": ["Unit"],
    "Stmt": [*_JS["Stmt"], "Type1 ;", "A n G", "A s G", "(A)* A n (TArgs)? (x Type (, Type)*)? G", "A V A n G", "A Stmt", "c A n G", "I A Stmt", "(Mark)* (A)* Cls", "(Mark)* I (L)? (A)* Cls", "(I)? (L)? (A)* F (b)? (Name)? (TArgs)? P (: Type)? ;", "Mark ;"],
    "Open": [*_JS["Open"], "Type1", "A Open", "I A G (M s)?", "I A n M s", "I A Open", "I n = n P", "I = Expr"],
    "Type1": ["(A)* n (TArgs)? = Type", "A (A)* n (TArgs)? = Type"],
    "Bind": ["Pattern (u)? (: Type)? (= Expr)?"],
    "Bound": ["Pattern (: Type)? = Expr", "Pattern : Type"],
    "Func": ["(A)? F (b)? (Name)? (TArgs)? P (: Type)? G"],
    "Cls": ["C (Name)? (TArgs)? (x Type (, Type)*)* G"],
    "Mark": ["@ n (. n)* (P)?"],
    "Member": ["(Mark)* (A)* (b)? Key (?)? (TArgs)? P (: Type)? G (;)?", "(Mark)* (A)* (b)? Key (?)? (TArgs)? P (: Type)? Sep", "(Mark)* (A)* Key (?)? (u)? (: Type)? (= Expr)? Sep", "(A)* Q (?)? : Type Sep", "(TArgs)? P (: Type)? Sep", "W P : Type Sep", "A G", ";"],
    "Sep": [";", ","],
    "Body": ["(Member)* (Rest)?", "Enum (, Enum)* (,)?"],
    "Rest": ["(A)* Key (?)? (TArgs)? P (: Type)?", "(A)* Key (?)? (u)? (: Type)? (= Expr)?", "(A)* Q (?)? : Type", "W P : Type", "(TArgs)? P : Type"],
    "Enum": ["Key (= Expr)?"],
    "TPart": ["n (. n)* (TArgs)?", "s", "0", "b 0", "G", "Q", "P", "A", "W", "r"],
    "Type": ["(o)? Type2 ((o) Type2)*"],
    "Type2": ["Type3 (b Type3)*", "(TArgs)? P a Type", "W (TArgs)? P a Type", "n A Type", "A n A Type", "Type3 x Type ? Type : Type"],
    "Type3": ["(TPre)* TPart (Q)*"],
    "TPre": ["A", "W"],
    "TArgs": ["o TArg (, TArg)* (,)? (o)?"],
    "TArg": ["Type (x Type)? (= Type)?", "n O Type"],
    "Param": ["(Mark)* (A)* Pattern (?)? (: Type)? (= Expr)?", "e Pattern (: Type)?"],
    "Paren": ["(List)?", "Param (, Param)* (,)?", "Type", "Type (, Type)*"],
    "Square": [*_JS["Square"], "Type (?)? (, Type (?)?)* (,)?", "n : Type", "n O Type", "TMember (, TMember)*"],
    "TMember": ["(e)? n (?)? : Type", "e Type"],
    "Elems": [*_JS["Elems"], "(Member)* (Rest)?", "(A)? NameAs (, (A)? NameAs)* (,)?"],
    "Expr": ["Unary (Bin Unary)* (As)* (Bin Unary (As)*)* (? Expr : Expr)?"],
    "As": ["M Type", "A Type", "M c"],
    "Unary": ["(Pre)* Atom (Tail)* (i)?", "o Type o Unary"],
    "Arrow": ["(A)? Name a Expr", "(A)? (TArgs)? P (: Type)? a Expr"],
    "Tail": [*_JS["Tail"], "u", "TArgs P"],
}
_JAVA = _EXPR | {
    "Top": ["(TopStmt)*"],
    "TopStmt": [";", "I (A)? n (. n)* (. b)? ;", "(Mod)* I n (. n)* ;", "Cls"],
    "Unit": ["(Stmt)*"],
    "Body": ["(Member)*", "Enum (, Enum)* (,)? (; (Member)*)?", "; (Member)*"],
    "Enum": ["(Mod)* n (P)? (G)?"],
    "Type": ["n (Gen)? (. n (Gen)?)* (Q)*"],
    "Gen": ["o (GArg (, GArg)*)? (o)?"],
    "GArg": ["Type", "?", "? x Type", "? W Type", "n x Type (b Type)*", "? n Type"],
    "Mod": ["A", "@ n (. n)* (P)?"],
    "Vars": ["Var (, Var)*"],
    "Var": ["n (Q)* (= Expr)?"],
    "Stmt": ["Expr ;", ";", "G", "(Mod)* Type Vars ;", "K P Stmt", "E Stmt", "E P G", "A P G", "R (Expr)? ;", "R Expr : Expr ;", "B (n)? ;", "Label :", "Label a Stmt", "n : Stmt", "Cls", "Member", "n Expr ;"],
    "Label": ["D Cases", "L"],
    "Cases": ["Case (, Case)* (n Expr)?"],
    "Case": ["Expr", "Type n", "L", "Type P"],
    "Cls": ["(Mod)* (n)? C n (Gen)? (P)? (x Type (, Type)*)* (n Type (, Type)*)? G", "(Mod)* @ C n G", "(Mod)* n n (Gen)? P (x Type (, Type)*)? G", "(Mod)* n b n C n (Gen)? (x Type (, Type)*)* G"],
    "Member": ["(Mod)* (Gen)? (Mod)* Type n P (Q)* (Throws)? G", "(Mod)* (Gen)? n P (Throws)? G", "(Mod)* (Gen)? Type n P (Q)* (Throws)? ;", "(Mod)* (Gen)? Type n P L Expr ;", "(Mod)* Type Vars ;", "A G", "G", "Cls", "(Mod)* n G", ";"],
    "Throws": ["x Type (, Type)*"],
    "Param": ["(Mod)* Type (e)? n (Q)*", "(Mod)* Type n . n"],
    "Paren": ["(List)?", "Param (, Param)*", "Type", "n (, n)*", "Res (; Res)* (;)?", "Type (b Type)*"],
    "Call": ["(List)?", "Type (b Type)*"],
    "Res": ["(Mod)* Type n = Expr", "Expr"],
    "Head": ["Expr", "(Init)? ; (Expr)? ; (List)?", "(Mod)* Type n : Expr", "(Mod)* Type (o Type)* n"],
    "Init": ["List", "(Mod)* Type Vars"],
    "Square": ["(Expr)?"],
    "Elems": ["(List)?"],
    "Atom": ["n", "0", "s (s)*", "P", "G", "W Type P (G)?", "W n (. n)* (Gen)? (Q)* (G)?", "n a Expr", "P a Expr", "Type . C", "K P G", "C", "A"],
    "Unary": ["(Pre)* Atom (Tail)* (i)?", "P Unary"],
    "Expr": ["Unary (Bin Unary)* (? Expr : Expr)?", "Unary O (A)? Type (n)? (Bin Unary (O Type (n)?)?)* (? Expr : Expr)?", "Unary (Bin Unary)* Bin Unary O (A)? Type (n)? (Bin Unary (O Type (n)?)?)* (? Expr : Expr)?"],
    "Tail": [". n", "P", "Q", ". Gen n", ". W n P", ". C", ". b"],
}
_GO = _EXPR | {
    "First": ["(;)* I n ;", "(;)*"],
    "Top": ["(TopStmt)*"],
    "TopStmt": [";", "I n ;", "I s ;", "I n s ;", "I . s ;", "I P ;", "V Spec ;", "V P ;", "F n (Q)? P (Result)? (G)? ;", "F P n P (Result)? (G)? ;"],
    "Unit": ["(Stmt ;)* (Stmt)?"],
    "Stmt": ["Exprs", "Exprs = Exprs", "Expr a Expr", "V Spec", "V P", "K (Head)? G", "Y If G (E Y If G)* (E G)?", "R (Exprs)?", "B (n)?", "G", "n : Stmt", "Case Stmt", "Case", ""],
    "Case": ["D Simple :", "D Types :", "L :"],
    "Simple": ["Exprs", "Exprs = Exprs", "Expr a Expr", "Exprs = a Expr"],
    "If": ["Simple", "(Simple)? ; Simple"],
    "Head": ["Simple", "(Simple)? ; (Simple)?", "(Simple)? ; (Simple)? ; (Simple)?", "Exprs = A Expr", "A Expr"],
    "Types": ["Type (, Type)*"],
    "Type": ["(TPre)* TPart"],
    "TPre": ["b", "Q", "A Q", "A a", "a A", "A", "u"],
    "TPart": ["n (. n)? (Q)?", "A G", "F P (Result)?", "P"],
    "Result": ["Type"],
    "Spec": ["n (, n)* Type (= Exprs)?", "n (, n)* = Exprs", "n (Q)? (=)? Type", "n"],
    "Fields": ["(Field ;)* (Field)?"],
    "Field": ["n (, n)* Type (s)?", "(b)? n (. n)? (Q)? (s)?", "n P (Result)?", "Type (o Type)*", ""],
    "Params": ["Param (, Param)* (,)?"],
    "Param": ["n Type", "n e Type", "Type", "e Type"],
    "Paren": ["(List)?", "Params", "V", "(Group ;)* (Group)?", "Type (, Expr)* (,)?"],
    "Call": ["(List)?"],
    "Group": ["Spec", "s", "n s", ". s", ""],
    "Square": ["(Expr)?", "(Expr)? : (Expr)? (: Expr)?", "e", "Types", "n (, n)* Type (o Type)* (, n (, n)* Type (o Type)*)*", "Type (o Type)*"],
    "Elems": ["(Elem (, Elem)* (,)?)?"],
    "Elem": ["(Expr :)? Expr"],
    "Atom": ["n", "0", "s", "P", "G", "F P (Result)? G", "Type G", "Type P", "b Type"],
    "Pre": ["b", "u", "a"],
    "Tail": [". n", ". P", "P", "Q", "e"],
    "Expr": ["Unary (Bin Unary)*"],
    "Bin": ["o", "b"],
    "Unary": ["(Pre)* Atom (Tail)* (i)?"],
    "Item": ["Expr (e)?", "Type"],
}
_C = _EXPR | {
    "Top": ["(TopStmt)*"],
    "TopStmt": [";", "G", "Specs ;", "Specs Inits ;", "(Specs)? Called G", "Specs Called Specs Decl (, Decl)* ;", "n P ;", "n P", "A s G"],
    "Unit": ["(Stmt)*"],
    "Body": ["(Stmt)*", "Enum (, Enum)* (,)?"],
    "Enum": ["n (= Expr)?"],
    "Specs": ["(A)* n (A)*", "A (A)*", "(A)* A (n)? G (A)*", "(A)* A (A)* n (A)*"],
    "Decl": ["(Ptr)* n (Suffix)*", "(Ptr)* P (Suffix)*"],
    "Called": ["(Ptr)* n P", "(Ptr)* P P"],
    "Ptr": ["b (A)*"],
    "Suffix": ["Q", "P"],
    "Inits": ["Init (, Init)*"],
    "Init": ["Decl (= Expr)?", "Decl : Expr", ": Expr"],
    "Stmt": ["Exprs ;", ";", "G", "Specs ;", "Specs Inits ;", "K P Stmt", "K P", "E Stmt", "R (Exprs)? ;", "B ;", "D Expr (e Expr)? :", "L :", "n :"],
    "Head": ["Exprs", "(Start)? ; (Exprs)? ; (Exprs)?"],
    "Start": ["Exprs", "Specs Inits"],
    "Param": ["Specs (Decl)?", "Specs (Ptr)* (Q)?", "Specs (Ptr)* (P P)?", "e"],
    "Paren": ["(List)?", "Param (, Param)*", "(Ptr)* n (Suffix)*", "(Ptr)* (A)* n (Suffix)*", "Ptr (Ptr)* (Q)?"],
    "Call": ["(List)?", "(Ptr)* (A)* n (Suffix)*", "Ptr (Ptr)* (Q)?", "Specs (Ptr)* P P"],
    "Square": ["(Expr)?", "A (Expr)?", "Expr e Expr"],
    "Elems": ["(Elem (, Elem)* (,)?)?"],
    "Elem": ["(Place =)? Expr"],
    "Place": ["(Step)* Step"],
    "Step": [". n", "Q"],
    "Item": ["Expr", "Specs (Ptr)* (Q)?"],
    "Expr": ["Unary (Bin Unary)* (? Expr : Expr)?"],
    "Atom": ["n (s)*", "0", "s (s)* (n (s)*)*", "P", "G", "W P", "W"],
    "Unary": ["(Pre)* Atom (Tail)* (i)?", "P Unary", "P G (Tail)*"],
    "Pre": ["b", "u", "i", "W", "o"],
    "Tail": [". n", "a n", "P", "Q"],
}
# Python: only texts that are surely valid; all others are asked of the exact parser. A unit begins with the last class of the line before (@ for a decorator), marks of
# indentation, and the kind of block that ended (see ``syntax._lines``).
_PYTHON = {
    "Unit": ["Before N Simples N", "Before N Head N", "Begin N Head N", "@ N @ Expr N", "@ N Def N", "Before N @ Expr N", "Begin N @ Expr N", "Begin N Simples N", "Ended N Late N", "Before N $", "Begin N $", "Ended N $"],
    "Begin": ["^", ": >"],
    "Last": ["n", "0", "s", "e", "P", "Q", "G", "R", "B", "b", "W", ";"],
    "Before": ["Last", "Last Out"],
    "Out": ["<", "< k", "< z", "< p", "< E"],
    "Ended": ["Last < k", "Last < z", "Last < p", "Last < y", "Last < E"],
    "Late": ["E : (Simples)?", "p (Expr)? (S n)? : (Simples)?", "p Expr , Expr : (Simples)?"],
    "Head": ["(A)? k Withs : (Simples)?", "(A)? z Targets O Exprs : (Simples)?", "y : (Simples)?", "Def"],
    "Def": ["(A)? F n P (a Expr)? : (Simples)?", "C n (P)? : (Simples)?"],
    "Withs": ["With (, With)*"],
    "With": ["Expr (S Target)?"],
    "Simples": ["Simple (; Simple)* (;)?"],
    "Simple": ["Exprs", "(Targets =)* Targets = Exprs", "(Targets =)* Targets = W Exprs", "Place h Exprs", "Place : Expr (= Expr)?", "g Place (, Place)*", "j Expr (, Expr)?", "R", "R Exprs", "R Expr M Expr", "B", "I Path (S n)? (, Path (S n)?)*", "M (Dots)? (Path)? I Names", "W (Exprs)?", "W M Expr"],
    "Dots": [".", "e", "Dots1 Dots"], "Dots1": [".", "e"], "Path": ["n (. n)*"], "Names": ["n (S n)? (, n (S n)?)*", "b", "P"],
    "Targets": ["Target (, Target)* (,)?"],
    "Target": ["(b)? Place"],
    "Place": ["n", "n (Step)* Sub", "s (Step)* Sub", "P (Step)* Sub"],
    "Sub": [". n", "Q"],
    "Step": [". n", "P", "Q"],
    "Exprs": ["Star (, Star)* (,)?"],
    "Star": ["(b)? Expr"],
    "Expr": ["Or (k Or E Expr)?", "l (Largs)? : Expr", "n w Expr"],
    "Or": ["(Pre)* Atom (Tail)* (Bin (Pre)* Atom (Tail)*)*"],
    "Bin": ["o", "b", "O", "u O", "O u", "@"],
    "Pre": ["b", "u", "W"],
    "Atom": ["n", "0", "s (s)*", "e", "P", "Q", "G"],
    "Tail": [". n", "P", "Q"],
    "Largs": ["Param (, Param)* (,)?"],
    "Param": ["n", "n = Expr", "b n", "o n"],
    "Paren": ["", "Star , (Star (, Star)*)? (,)?", "Comp", "W (Exprs)?", "W M Expr", "n = Expr", "Names2", "Args (,)?", "Pars (,)?"],
    "Names2": ["n (S n)? (, n (S n)?)* (,)?"],
    "Args": ["Plain (, Plain)* (, Named)*", "Named (, Named)*"], "Plain": ["Expr", "b Expr"], "Named": ["n = Expr", "o Expr"],
    "Pars": ["Par (, Par)* (, o)? (, Par)* (, Def1)* (, b (n Hint)? (, Key1)*)? (, o n Hint)?", "Def1 (, Def1)* (, b (n Hint)? (, Key1)*)? (, o n Hint)?", "b n Hint (, Key1)* (, o n Hint)?", "b , Key1 (, Key1)* (, o n Hint)?", "o n Hint"],
    "Par": ["n Hint"], "Def1": ["n Hint = Expr"], "Key1": ["n Hint (= Expr)?"], "Hint": ["(: Expr)?"],
    "Comp": ["Expr For"], "For": ["(A)? z Targets O Or (Filter)*"], "Filter": ["k Or", "For"],
    "Square": ["", "Exprs", "Comp", "Slice (, Slice)* (,)?"],
    "Slice": ["(Expr)? : (Expr)?", "(Expr)? : (Expr)? : (Expr)?", "Expr"],
    "Elems": ["", "Exprs", "Comp", "Pair (, Pair)* (,)?", "Pair For"],
    "Pair": ["Expr : Expr", "o Expr"],
}
_GRAMMARS = {"javascript": _JS, "typescript": _JS | _TS, "java": _JAVA, "go": _GO, "c": _C, "python": _PYTHON}
#: Tags of a unit, by its place: t at the outer level, u in a block, e in an expression's curly brackets, c in a class or type body, b where a block or an expression's brackets can stand.
TAGS = {"f": ("First",), "t": ("Top",), "u": ("Unit",), "e": ("Elems",), "c": ("Body", "Unit"), "b": ("Unit", "Elems", "Body")}
#: What stands before a name whose round brackets may hold declarations (^ is the begin of a declaration).
_DECLARES = {"c": "nAb^", "java": "nAo]^)", "go": "F)^]"}
#: Other classes before round brackets that may hold declarations.
_OPENS = {"c": ")]A", "java": "EA", "go": "F)IV.]"}
#: Statements that no unit begins with: a function statement without a name.
_NEVER = {"javascript": re.compile("A?Fb?P"), "typescript": re.compile("A?Fb?P")}


def start_of(language: str, opener: str, before: str, after: str) -> tuple[str, ...]:
    """The productions that what a bracket holds may follow; ``before`` are the two classes before the bracket, ``after`` is the one behind it."""
    if opener == "(":
        last = before[-1:]
        if language in ("javascript", "typescript"):
            return ("Head",) if last == "K" else ("Head", "Paren") if last == "W" else ("Paren",)
        if language in _DECLARES:
            if last == "K" and language != "go":
                return ("Head",)
            declares = before[0] in _DECLARES[language] if last == "n" else last in _OPENS[language] or (language == "java" and after == "a")
            return ("Paren",) if declares else ("Call",)
        return ("Paren",)
    if opener == "[":
        return ("Square",)
    if opener == "{":
        return ("Elems",)
    if language == "go" and opener == "c":
        return ("Fields", "Unit", "Elems")
    if language == "javascript" and opener == "c":
        return ("Body",)
    return tuple(x for x in TAGS[opener] if x in _GRAMMARS[language]) or ("Unit",)


def _tree(text: str) -> list[tuple[object, str]]:
    """Groups are written '(' directly before a symbol and ')' directly behind one, with * or ?; the tokens ( and ) stand alone."""
    out: list[tuple[object, str]] = []
    stack = [out]
    for raw in text.split():
        opens = 0
        while len(raw) > 1 and raw[0] == "(":
            raw, opens = raw[1:], opens + 1
        closing = []
        while len(raw) > 2 and raw[-1] in "*?" and raw[-2] == ")":
            closing.append(raw[-1])
            raw = raw[:-2]
        while len(raw) > 1 and raw[-1] == ")":
            closing.append("")
            raw = raw[:-1]
        for _ in range(opens):
            inner: list[tuple[object, str]] = []
            stack[-1].append((inner, ""))
            stack.append(inner)
        stack[-1].append((raw, ""))
        for mark in reversed(closing):
            inner = stack.pop()
            stack[-1][-1] = (inner, mark)
    return out


class Grammar:
    """Productions of one language: what can be first and last in each, which classes can be adjacent, and whether a text follows a production."""

    def __init__(self, language: str):
        self.never = _NEVER.get(language)
        self.rules = {name: [_tree(alt) for alt in alts] for name, alts in _GRAMMARS[language].items()}
        self.first: dict[str, set[str]] = {n: set() for n in self.rules}
        self.last: dict[str, set[str]] = {n: set() for n in self.rules}
        self.empty: dict[str, bool] = {n: False for n in self.rules}
        self.pairs: set[str] = set()
        size = lambda: len(self.pairs) + sum(map(len, self.first.values())) + sum(map(len, self.last.values())) + sum(self.empty.values())
        before = -1
        while before != size():
            before = size()
            for name, alts in self.rules.items():
                for alt in alts:
                    f, la, e = self._run(alt)
                    self.first[name] |= f
                    self.last[name] |= la
                    self.empty[name] = self.empty[name] or e
        self.leads = {name: [self._run(alt)[::2] for alt in alts] for name, alts in self.rules.items()}

    def _look(self, part: object, mark: str) -> tuple[set[str], set[str], bool]:
        if isinstance(part, list):
            f, la, e = self._run(part)
            if mark == "*":
                self.pairs.update(a + b for a in la for b in f)
            return f, la, e or mark in ("*", "?")
        if part in self.rules:
            return self.first[part], self.last[part], self.empty[part]
        return {part}, {part}, False

    def _run(self, parts: list[tuple[object, str]]) -> tuple[set[str], set[str], bool]:
        f: set[str] = set()
        open_last: set[str] = set()
        all_empty = True
        for part, mark in parts:
            pf, pl, pe = self._look(part, mark)
            self.pairs.update(a + b for a in open_last for b in pf)
            if all_empty:
                f = f | pf
            open_last = (open_last | pl) if pe else set(pl)
            all_empty = all_empty and pe
        return f, open_last, all_empty

    def follows(self, text: str, starts: tuple[str, ...]) -> bool:
        """Whether the whole text is one of the productions; every way to read it is tried at once, so there is no backtracking."""
        n = len(text)
        memo: dict[tuple[str, int], frozenset[int]] = {}

        def of(name: str, i: int) -> frozenset[int]:
            found = memo.get((name, i))
            if found is None:
                memo[name, i] = frozenset()
                c = text[i] if i < n else ""
                out: set[int] = set()
                for alt, (lead, empty) in zip(self.rules[name], self.leads[name], strict=True):
                    if c in lead:
                        out |= run(alt, i)
                    elif empty:
                        out.add(i)
                found = memo[name, i] = frozenset(out)
            return found

        def run(parts: list[tuple[object, str]], i: int) -> set[int]:
            now = {i}
            for part, mark in parts:
                after: set[int] = set()
                for k in now:
                    if not isinstance(part, list):
                        if part in self.rules:
                            after |= of(part, k)
                        elif k < n and text[k] == part:
                            after.add(k + 1)
                    elif mark == "*":
                        seen, todo = {k}, [k]
                        while todo:
                            for e in run(part, todo.pop()):
                                if e not in seen:
                                    seen.add(e)
                                    todo.append(e)
                        after |= seen
                    else:
                        after |= run(part, k)
                        if mark == "?":
                            after.add(k)
                now = after
                if not now:
                    break
            return now

        if starts[0] in ("Top", "Unit") and self.never is not None and self.never.match(text):
            return False
        return any(n in of(start, 0) for start in starts if start in self.rules)


@lru_cache(maxsize=8)
def grammar(language: str) -> Grammar:
    return Grammar(language)


def permitted(language: str) -> frozenset[str]:
    """All two-letter strings of classes that can be adjacent in some text of the grammar."""
    return frozenset(grammar(language).pairs)


class Lexer:
    """Class strings of whole texts of one language; classes of words and signs are remembered."""

    def __init__(self, language: str):
        self.language = language
        words = {w: c for c, ws in _WORDS[language].items() for w in ws.split()}
        signs = {s: c for c, ss in _SIGNS.items() for s in ss.split()}
        self.known = _Classes(language, words, signs)
        skip, token = (_PY_SKIP, _PY_TOKEN) if language == "python" else _TOKENS[language]
        end = "" if language == "python" else r"(?:\r\n|\r|\n)\s*|"
        self.find = re.compile(rf"(?:{skip})*+({end}{token}|[\s\S])").findall

    def classes(self, text: str) -> str:
        return "".join(map(self.known.__getitem__, self.find(text)))


class _Classes(dict):
    def __init__(self, language: str, words: dict[str, str], signs: dict[str, str]):
        super().__init__({c: c for c in _PLAIN} | signs | words | {"?.": ".", "::": "." if language == "java" else "X", "#": "X"})
        self.language = language
        if language in ("javascript", "typescript"):
            self.pop("?.", None)
            self["?."] = "?."
        if language == "python":
            for c in "?$!~{}":
                self[c] = {"{": "{", "}": "}", "~": "u"}.get(c, "X")
            self["++"] = self["--"] = "X"
            self.update({x: "h" for x, c in signs.items() if c == "=" and x != "="} | {":=": "w"})
        elif language in ("c", "go", "java"):
            self["**"] = "bb"

    def __missing__(self, t: str) -> str:
        c = t[0]
        if self.language == "python":
            if c in "\r\n":
                return chr(INDENT_BASE + len(t.lstrip("\r\n").expandtabs(8)))
            if t[-1] in "\"'" and len(t) > 1:
                return "s"
        else:
            if c in "\r\n":
                return "\n"
            if self.language == "c" and t.lstrip().startswith("#"):
                return "" if len(t.lstrip()) > 1 else "X"
            if len(t) > 1 and t[-1] in "\"'`" and c not in "=(,:[!&|?{};":
                return "s"
            if len(t) > 2 and c in "=(,:[!&|?{};" and "/" in t:
                return ({"!": "u", "&": "b", "|": "o"}.get(c, c)) + "r"
            if "/" in t and c.isalpha() and self.language in ("javascript", "typescript"):
                return self.get(re.match(r"\w+", t)[0], "n") + "r"
        if c.isdigit() or (c == "." and len(t) > 1 and t[1].isdigit()):
            v = "X" if self.language == "python" and _ODD_NUMBER.fullmatch(t) else "0"
        elif c.isalpha() or c in "_$" or (c == "#" and len(t) > 1):
            v = "n"
        elif c in " \t\f\v":
            v = ""
        else:
            v = "X"
        if len(t) <= 40:
            if len(self) > 200_000:
                return v
            self[t] = v
        return v
