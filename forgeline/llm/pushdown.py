"""A pushdown automaton over token shapes (problem 2).

A rule reads ``SYMBOL: tokens > symbols``: with SYMBOL on top of the stack and one of the tokens next, the token is
consumed and the symbols replace SYMBOL, first one on top. ``=token`` only looks at the token. ``W`` stands for any
word, ``a`` for a name, ``NL`` for any token that begins a line (always looked at, and before a token's own rule
where written ``NLtoken``), ``END`` for the end of the file and ``*`` for what else comes (looked at). A symbol in
quotes is a token that must come. ``{`` to ``}`` sections of rules hold for one language.

Files share most of their line shapes, so what a line does to a stack is remembered for each pair of the two.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(r"[A-Za-z_]+|>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|//=|=>|->|:=|==|!=|<=|>=|&&|\|\||\?\?|\?\.|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|\*\*|//|<<|>>|\S")
_PY_TOKEN = re.compile(r"[A-Za-z_]+|\.\.\.|\*\*=|<<=|>>=|//=|->|:=|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|\*\*|//|<<|>>|\S")
_CONFLICT = re.compile(r"(?:<{7}|>{7}|\|{7})(?: .*)?$|={7}$")

JS = r"""
S*: END > .
S*: * > S S*
SB: } > .
SB: * > S SB
SW: } > .
SW: case > E ':' SW
SW: default > ':' SW
SW: * > S SW
S: ; > .
S: { > SB
S: var > VD ;;
S: let > LET
S: const > VDc ;;
LET: =a =[ ={ > VD ;;
LET: * > X C ;;
S: function > FN FP FB
S: async > AS
AS: function > FN FP FB
AS: * > X C ;;
S: class > CH
S: if > '(' L) S IE
IE: else > S
IE: * > .
S: while with > '(' L) S
S: for > FO
FO: await > FO
FO: ( > FH S
FH: ) > .
FH: ; > FH
FH: var let const > VD FH
FH: of in > E FH
FH: * > E FH
S: do > S 'while' '(' L) OS
OS: ; > .
OS: * > .
S: switch > '(' L) '{' SW
S: try > '{' SB TF
TF: catch > CA1
TF: finally > '{' SB
CA1: ( > L) '{' SB T2
CA1: { > SB T2
T2: finally > '{' SB
T2: * > .
S: return > RE
RE: NL > ;;
RE: =; =} > ;;
RE: * > E ;;
S: throw > E ;;
S: break continue > OI ;;
OI: NL > .
OI: a > .
OI: * > .
S: debugger > ;;
S: import > IM
S: export > EX
S: @ > DE S
S: a > XI
XI: : > S
XI: * > X C ;;
S: * > E ;;
;;: ; > .
;;: NL > .
;;: =} END > .
E: * > A C
C: , > A C
C: * > .
A: * > O
O: a s n this super null true false import > X
O: ` > X
O: ( > L) Xp
O: [ > L] X
O: { > L} X
O: ! ~ + - ++ -- typeof void delete await > O
O: yield > YE
YE: NL > X
YE: =) =] =} =, =; =: END > X
YE: * > YEs
YEs: ** > O
YEs: mul > O
O: new > NEW
NEW: . > W X
NEW: * > O
O: function > FN FP FB X
O: class > CH X
O: async > ASe
ASe: function > FN FP FB X
ASe: a > X
ASe: * > X
O: @ > DE O
X: . > W X
X: ?. > QD
QD: ( > L) X
QD: [ > L] X
QD: ` > X
QD: W > X
X: ( > L) Xp
X: [ > L] X
X: ` > X
X: + - mul / % ** == != === !== < > <= >= && || ?? & | ^ << >> >>> in instanceof > O
X: = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= > O
X: => > AB
AB: { > SB X
AB: * > O
X: ? > QT
QT: * > A ':' O
X: NL++ NL-- > .
X: ++ -- > X
X: * > .
Xp: * > X
L): ) > .
L): ... > A M)
L): * > A M)
M): , > L)
M): ) > .
L]: ] > .
L]: , > L]
L]: ... > A M]
L]: * > A M]
M]: , > L]
M]: ] > .
L}: } > .
L}: ... > A M}
L}: get set async > Pm
L}: W s n > P}
L}: [ > A ']' P}
L}: mul > PN
PN: W s n > P}
PN: [ > A ']' P}
Pm: W s n > P}
Pm: [ > A ']' P}
Pm: mul > PN
Pm: * > P}
P}: : > A M}
P}: , > L}
P}: } > .
P}: ( > L) FB M}
P}: = > A M}
M}: , > L}
M}: } > .
FN: mul > FN
FN: a > .
FN: =( > .
FP: ( > L)
FB: { > SB
CH: a > CH
CH: extends > HE
CH: { > CM
HE: * > A CH
CM: } > .
CM: ; > CM
CM: @ > DE CM
CM: static async get set accessor > CMm
CM: W s n > CA
CM: [ > L] CA
CM: mul > CM
CMm: { > SB CM
CMm: =( == =; =} =, > CA
CMm: NL > CA
CMm: static async get set accessor > CMm
CMm: W s n > CA
CMm: [ > L] CA
CMm: mul > CM
CA: ( > L) FB CM
CA: = > A CE
CA: ; > CM
CA: } > .
CA: NL > CM
CE: ; > CM
CE: } > .
CE: NL > CM
DE: a > DX
DE: ( > L)
DX: . > W DX
DX: ( > L)
DX: * > .
IM: s > IW
IM: ( > L) X C ;;
IM: . > W X C ;;
IM: { > IL 'from' IS
IM: mul > 'as' W 'from' IS
IM: a > IM2
IS: s > IW
IW: with > '{' L} ;;
IW: * > ;;
IM2: , > IM3
IM2: from > IS
IM3: { > IL 'from' IS
IM3: mul > 'as' W 'from' IS
IL: } > .
IL: W s > IA
IA: as > IAs
IAs: W s > IC
IA: , > IL
IA: } > .
IC: , > IL
IC: } > .
EX: default > ED
EX: { > IL EF
EX: mul > ES
EX: =var =let =const =function =class =async =@ > S
ED: function > FN FP FB
ED: class > CH
ED: async > AS
ED: * > A ;;
EF: from > IS
EF: * > ;;
ES: as > ESa
ESa: W s > 'from' IS
ES: from > IS
VD: a > VT
VD: [ > L] VT
VD: { > L} VT
VT: = > A VC
VT: * > VC
VC: , > VD
VC: * > .
VDc: a > VTc
VDc: [ > L] VTc
VDc: { > L} VTc
VTc: = > A VCc
VCc: , > VDc
VCc: * > .
"""

TS = r"""
S: interface > IF0
S: type > TY
S: enum > W '{' EL
S: namespace module > NS
S: declare > DC
S: abstract > AB0
S: global > GL
GL: { > SB
GL: * > XI
IF0: NL > XI
IF0: W > IH
IF0: * > XI
IH: < > TG IH
IH: extends > Ty IX
IH: { > TM
IX: , > Ty IX
IX: * > IH
TY: NL > XI
TY: W > TQ
TY: { > IL EF
TY: * > XI
TQ: < > TG TQ
TQ: = > Ty ;;
EL: } > .
EL: W s > EA
EA: = > A EM
EA: , > EL
EA: } > .
EM: , > EL
EM: } > .
NS: NL > XI
NS: W s > NS2
NS: * > XI
NS2: . > W NS2
NS2: { > SB
NS2: ; > .
NS2: NL > .
DC: const > DCc
DCc: enum > W '{' EL
DCc: * > VD ;;
DC: =var =let =function =class =abstract =interface =type =enum =namespace =module =global =async > S
DC: * > XI
AB0: class > CH
AB0: * > XI
VDc: enum > W '{' EL
VT: : > Ty VT
VT: ! > VT
VTc: : > Ty VTc
O: < > TG O
X: as satisfies > Ty X
X: NL! > .
X: ! > X
QT: : > Ty X
QT: =, =) == > X
L): public private protected readonly override > Lm
Lm: =, =) =: =. => =( =[ =? == > X M)
Lm: * > L)
L): @ > DE L)
P}: < > TG P}
P}: ? > P}
FN: =< > .
FP: < > TG FP
FB: : > Ty FB
FB: ; > .
FB: NL > .
FB: =} > .
CH: implements > Ty CI
CH: < > TG CH
CI: , > Ty CI
CI: * > CH
HE: * > Ty HC
HC: ( > L) HC
HC: . > W HC
HC: * > CH
CM: public private protected readonly abstract declare override > CMm
CMm: public private protected readonly abstract declare override > CMm
CMm: =: =? =! =< > CA
CA: ? ! > CA
CA: : > Ty CE
CA: < > TG CA
CE: = > A CE
IM: type > IMt
IM: a > IM2
IMt: from > IS
IMt: , > IM3
IMt: * > IM
IM2: = > E ;;
IA: W > IAt
IAt: as > IAs
IAt: W > IAs0
IAs0: as > IAs
IAs0: * > IC
IAt: * > IC
EX: =interface =enum =namespace =module =declare =abstract =import > S
EX: type > TY
EX: = > E ;;
EX: as > 'namespace' W ;;
ED: abstract > 'class' CH
ED: interface > IF0
Ty: | & > Ty
Ty: keyof typeof readonly unique infer asserts abstract new > Tp
Tp: =) =] =} =, =; == =| =& => => =[ > TX
Tp: NL > TX
Tp: * > Ty
Ty: W s n ` > TX
Ty: - > Ty
Ty: ( > TL) TF
TF: => > Ty
TF: * > TX
Ty: [ > TL] TX
Ty: { > TM TX
Ty: < > TG Ty
TX: NL[ NL( NL< > .
TX: [ > TL] TX
TX: . > W TX
TX: | & is > Ty
TX: extends > Ty TC
TX: < > TG TX
TX: * > .
TC: ? > Ty ':' Ty
TC: * > .
TL): ) > .
TL): ... > Ty TN)
TL): * > Ty TN)
TN): ? > TN)
TN): : > Ty TN)
TN): = > A TN)
TN): , > TL)
TN): ) > .
TL]: ] > .
TL]: ... > Ty TN]
TL]: * > Ty TN]
TN]: ? > TN]
TN]: : > Ty TN]
TN]: , > TL]
TN]: ] > .
TG: > > .
TG: , > TG
TG: const in > TG
TG: * > Ty TH
TH: , > TG
TH: > > .
TH: = > Ty TH
TM: } > .
TM: ; , > TM
TM: [ > SK] TA
TM: ( > TL) TE
TM: < > TG TM
TM: + - > TM
TM: W s n > TA
SK]: ] > .
SK]: [ > SK] SK]
SK]: END > fail
SK]: skip > SK]
TA: NLW NL[ NL( > TM
TA: ? ! - + > TA
TA: : > Ty TE
TA: ( > TL) TE
TA: < > TG TA
TA: W s > TA
TA: [ > SK] TA
TA: ; , > TM
TA: } > .
TA: NL > TM
TE: : > Ty TE
TE: ; , > TM
TE: } > .
TE: NL > TM
"""

PYTHON = r"""
S: pass break continue > SE
S: NL > .
SE: ; > S
SE: NL > .
S: return > RO SE
RO: =; NL > .
RO: * > E
S: raise > RO FRM SE
FRM: from > A
FRM: * > .
S: import > IMP
IMP: a > IMA
IMA: . > IMP
IMA: as > 'a' IMC
IMA: , > IMP
IMA: * > SE
IMC: , > IMP
IMC: * > SE
S: from > FRO
FRO: . ... > FRO
FRO: import > FRI
FRO: a > FRA
FRA: . > FRB
FRB: a > FRA
FRA: import > FRI
FRI: mul > SE
FRI: ( > FRP
FRI: a > FRN
FRN: as > 'a' FRM2
FRN: , > FRL
FRN: * > SE
FRL: a > FRN
FRM2: , > FRL
FRM2: * > SE
FRP: ) > SE
FRP: a > FPN
FPN: as > 'a' FPC
FPN: , > FRP
FPN: ) > SE
FPC: , > FRP
FPC: ) > SE
S: global nonlocal > GL
GL: a > GC
GC: , > GL
GC: * > SE
S: del assert > E SE
S: if while elif > A ':' SU
S: else try finally > ':' SU
S: except > EXC
EXC: : > SU
EXC: mul > EXC
EXC: * > E EXA
EXA: as > 'a' ':' SU
EXA: : > SU
S: for > E ':' SU
S: with > WI
WI: * > A WA
WA: as > A WC
WA: * > WC
WC: , > WI
WC: : > SU
S: def > 'a' '(' PL RET
RET: -> > A ':' SU
RET: : > SU
PL: ) > .
PL: mul ** > PS
PL: / > PC
PL: a > PA
PS: a > PA
PS: , > PL
PS: ) > .
PA: : > A PD
PA: = > A PC
PA: , > PL
PA: ) > .
PD: = > A PC
PD: , > PL
PD: ) > .
PC: , > PL
PC: ) > .
S: class > 'a' CLS
CLS: ( > L) ':' SU
CLS: : > SU
S: async > ASY
ASY: =def =for =with > S
S: @ > E SE
S: match case > MA
MA: =a =s =n =not =[ ={ =None =True =False > E ':' SU
MA: * > X C ANN
S: * > E ANN
ANN: : > A ANQ
ANN: = > E ANE
ANN: += -= *= /= //= %= **= <<= >>= &= |= ^= @= > E SE
ANN: * > SE
ANE: = > E ANE
ANE: * > SE
ANQ: = > E SE
ANQ: * > SE
SU: NL > NB
SU: * > S
E: * > A C
C: , > CE
C: * > .
CE: =) =] =} == =: =; NL > .
CE: * > A C
A: mul ** > O
A: * > O
O: a n None True False match case ... > X
O: s > Xs
Xs: s > Xs
Xs: * > X
O: ( > L) X
O: [ > L] X
O: { > L} X
O: - + ~ not await > O
O: lambda > LP
LP: : > A
LP: mul ** / > LP
LP: , > LP
LP: a > LA
LA: = > A LC
LA: , > LP
LA: : > A
LC: , > LP
LC: : > A
O: yield > YI
YI: from > A
YI: =) == NL > .
YI: * > E
X: . > XN
XN: a match case > X
X: ( > L) X
X: [ > SL] X
X: + - mul / // % @ ** & | ^ << >> == != < > <= >= and or in > O
X: is > ISN
ISN: not > O
ISN: * > O
X: not > 'in' O
X: if > O TE
TE: else > A
TE: =) =] =} =for =if =async > .
X: := > A
X: * > .
L): ) > .
L): * > A M)
M): , > L)
M): ) > .
M): = > A M)
M): for > CF M)
M): async > 'for' CF M)
M): if > A M)
CF: * > E
L]: ] > .
L]: * > A M]
M]: , > L]
M]: ] > .
M]: for > CF M]
M]: async > 'for' CF M]
M]: if > A M]
SL]: ] > .
SL]: : , > SL]
SL]: * > A SM]
SM]: : , > SL]
SM]: ] > .
SM]: for > CF SM]
L}: } > .
L}: * > A D}
D}: : > A M}
D}: , > L}
D}: } > .
D}: for > CF D}
D}: if > A D}
M}: , > L}
M}: } > .
M}: for > CF M}
M}: if > A M}
"""


def _rules(*texts: str) -> dict[str, dict[str, tuple[bool, tuple[str, ...]]]]:
    rules: dict[str, dict[str, tuple[bool, tuple[str, ...]]]] = {}
    for line in "\n".join(texts).strip().splitlines():
        symbol, _, rest = line.partition(": ")
        tokens, _, to = rest.rpartition(" > ")
        put = tuple(reversed([x for x in to.split() if x != "."]))
        for t in tokens.split():
            peek = t in ("NL", "*", "END") or t[:2] == "NL" or t[0] == "=" and len(t) > 1 and t not in ("=>", "==", "===")
            if t in ("==", "=>") and len(tokens.split()) > 1 and "=" + t[1:] and any(u[0] == "=" and u not in ("==", "=>", "===") and len(u) > 1 for u in tokens.split()):
                peek = True  # "=" and ">" looked at, among other tokens that are
            key = t[1:] if peek and t[0] == "=" and len(t) > 1 else t
            rules.setdefault(symbol, {})[key] = (not peek, put)
    return rules


class Automaton:
    """One language's rules with the memory of what lines do. ``memory`` bounds the remembered pairs."""

    def __init__(self, *texts: str, contextual: frozenset = frozenset(), python: bool = False, memory: int = 400_000):
        self.rules, self.contextual, self.python, self.limit = _rules(*texts), contextual, python, memory
        self.forget()

    def forget(self) -> None:
        self.stacks: list[tuple[str, ...]] = [("B||",) if self.python else ("S*",)]
        self.ids = {self.stacks[0]: 0}
        self.memory: dict[tuple[int, str], int] = {}

    def _id(self, stack: list[str]) -> int:
        key = tuple(stack)
        if key not in self.ids:
            self.ids[key] = len(self.stacks)
            self.stacks.append(key)
        return self.ids[key]

    def feed(self, stack: list[str], token: str, first: bool) -> bool:
        """Apply one token to the stack; False if no rule takes it."""
        word = token[0].isalpha() and token not in ("s", "n", "END", "NL") if token else False
        name = token == "a" or token in self.contextual
        if token == "*":
            token = "mul"
        while stack:
            if token == "NL" and (stack[-1] == "NB" or stack[-1][:2] == "B|"):
                return True
            top = stack.pop()
            if top[0] == "'":
                return token == top[1:-1] or token == "mul" and top == "'*'" or top == "'a'" and name
            if top == "W":
                return word
            rules = self.rules.get(top)
            if rules is None:
                return False
            if not self.python and token == ":" and top in ("X", "Xp") and self._annotates(stack, top):
                stack.extend(("X", "Ty") if top == "X" else ("X", "Ty"))
                return True
            found = None
            if first:
                found = rules.get("NL" + token) or word and rules.get("NLW")
            found = found or rules.get(token) or name and rules.get("a") or word and rules.get("W") or first and rules.get("NL") or top == "SK]" and rules["skip"] or rules.get("*")
            if not found:
                if token[:2] == ">>" and top in ("TG", "TH") or token in (">=", ">>=") and top in ("TG", "TH"):
                    token = token[1:]  # the first of the closing marks ends these arguments
                    continue
                return False
            eats, put = found
            stack.extend(put)
            if eats:
                return put != ("fail",)
        return token == "END"

    def _annotates(self, stack: list[str], top: str) -> bool:
        """Whether a colon after an operand is a TypeScript annotation: of a parameter or of what an arrow returns."""
        if "Ty" not in self.rules:
            return False
        below = next((x for x in reversed(stack) if x not in ("C", "X")), "")
        return below in ("M)", "M]") or top == "Xp" and below != "':'"

    def _line(self, stack: list[str], line: str) -> bool:
        tokens = (_PY_TOKEN if self.python else _TOKEN).findall(line)
        if not self.python:
            return all(self.feed(stack, t, k == 0) for k, t in enumerate(tokens))
        indent = line[: len(line) - len(line.lstrip())]
        if not self._block(stack, indent, tokens[0]):
            return False
        if not all(self.feed(stack, t, False) for t in tokens):
            return False
        inside = any(x[-1] in ")]}" and x[0] != "'" or x in ("PL", "PA", "PS", "PC", "PD", "FRP", "FPN", "FPC") for x in stack[self._top(stack) + 1 :])
        return inside or self.feed(stack, "NL", True)

    @staticmethod
    def _top(stack: list[str]) -> int:
        return next(k for k in range(len(stack) - 1, -1, -1) if stack[k][:2] == "B|")

    def _block(self, stack: list[str], indent: str, word: str) -> bool:
        """Begin a statement of Python: open or close blocks by its indentation. Blocks are ``B|indent|last word``."""
        if stack[-1] == "NB":
            above = stack[-2].split("|")[1]
            if not indent.startswith(above) or indent == above:
                return False
            stack[-1] = f"B|{indent}|"
        elif stack[-1][:2] != "B|":
            return True  # inside brackets
        while stack and stack[-1].split("|")[1] != indent:
            stack.pop()
        if not stack:
            return False
        last = stack[-1].split("|")[2]
        needs = {"elif": ("if", "elif"), "else": ("if", "elif", "for", "while", "except"), "except": ("try", "except"), "finally": ("try", "except", "else")}.get(word)
        if needs and last not in needs or last == "try" and not needs or last == "@" and word not in ("def", "class", "async", "@"):
            return False
        stack[-1] = f"B|{indent}|{'for' if word == 'async' else word if word in ('if', 'elif', 'else', 'for', 'while', 'try', 'except', 'finally', '@') else ''}"
        stack.append("S")
        return True

    def failure(self, shape: str) -> str | None:
        """None for a shape that the rules accept, else the kind of failure."""
        if len(self.memory) > self.limit or len(self.stacks) > self.limit:
            self.forget()
        state, memory = 0, self.memory
        for line in shape.split("\n"):
            if not line or line.isspace():
                continue
            line = line.rstrip() if self.python else line.strip()
            key = (state, line)
            after = memory.get(key)
            if after is None:
                stack = list(self.stacks[state])
                after = self._id(stack) if self._line(stack, line) else -1
                memory[key] = after
            if after < 0:
                return self._kind(line)
            state = after
        stack = list(self.stacks[state])
        if self.python:
            ended = stack[-1][:2] == "B|" and not stack[-1].endswith(("|try", "|@"))
            return None if ended else "premature end"
        return None if self.feed(stack, "END", True) and not stack else "premature end"

    @staticmethod
    def _kind(line: str) -> str:
        line = line.strip()
        if _CONFLICT.match(line):
            return "merge conflict"
        if re.search("[\"'`]", line):
            return "unterminated literal"
        if line[:1] in "}])":
            return "unbalanced delimiter"
        return "misplaced token"
