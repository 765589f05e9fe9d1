"""Grammars over the token classes of ``lexers``. They check syntax only."""

from __future__ import annotations

from functools import cache

from evidra.llm.derivative import Grammar
from evidra.llm.lexers import JS_KEYWORDS, RB_KEYWORDS, TS_KEYWORDS, Tokens, tokens

#: Extension of a path -> language.
LANGUAGES = {"ts": "typescript", "js": "javascript", "mjs": "javascript", "py": "python", "go": "go", "java": "java", "rb": "ruby", "json": "json"}

JSON = """
top = value
value = STR | NUM | 'true' | 'false' | 'null' | object | array
object = '{' ( pair ( ',' pair )* )? '}'
pair = STR ':' value
array = '[' ( value ( ',' value )* )? ']'
"""


def _choice(words: object) -> str:
    return " | ".join(f"'{w}'" for w in sorted(words))


def _javascript(ts: bool) -> str:
    """The grammar of scripts and modules, with or without types."""
    contextual = {"async", "static", "get", "set", "of", "from", "as", "await", "yield", "let"}
    keywords = JS_KEYWORDS
    if ts:
        contextual |= TS_KEYWORDS - JS_KEYWORDS - {"enum"}
        keywords = TS_KEYWORDS
    t = (lambda typed, plain="": typed) if ts else (lambda typed, plain="": plain)
    ann = t(" typeann?")
    mods = _choice({"static", "async", "get", "set"} | ({"public", "private", "protected", "readonly", "override", "abstract", "declare"} if ts else set()))
    return f"""
program = stmts
id = ID | {_choice(contextual)}
name = id | {_choice(keywords - contextual)}
stmts = full*
full = ';' | block | simple ';' | func | class | 'if' paren ';'? full ';'? ( 'else' full )? | 'for' 'await'? forhead ';'? full | 'while' paren ';'? full
  | 'do' full 'while' paren | 'switch' paren '{{' case* '}}' | 'try' block catch | id ':' full | 'export' ( func | class | 'default' ( func | class | object ) ) | 'with' paren full {t("| tsfull | 'export' tsfull | 'export' 'default' 'interface' id tparams? heritage members | decorator+ ';'? ( class | 'export' 'default'? class )")}
simple = decl | expr0 | 'throw' expr | 'return' expr? | 'break' id? | 'continue' id? | 'debugger' | import | export {t("| 'declare'? 'type' id tparams? '=' type | 'declare' ( decl | 'function' id tparams? params typeann? | 'global' block ) | 'function' id tparams? params typeann? | 'export' ( 'declare'? 'type' id tparams? '=' type | '=' expr | 'declare' decl | 'default'? 'async'? 'function' id? tparams? params typeann? )")}
block = '{{' stmts '}}'
paren = '(' expr ')'
forhead = '(' ( decl | expr )? ';' expr? ';' expr? ')' | '(' ( ( 'var' | 'let' | 'const' ) target | lhs ) ( 'of' assign | 'in' expr ) ')'
lhs = primary postfix*
case = ( 'case' expr | 'default' ) ':' stmts
catch = 'catch' ( '(' target{ann} ')' )? block ( 'finally' block )? | 'finally' block
decl = ( 'var' | 'let' ) binding ( ',' binding )* | 'const' {t("( binding ( ',' binding )* | 'enum' id '{{' ( enumerator ( ',' enumerator )* ','? )? ';'? '}}' )", "bound ( ',' bound )*")}
bound = target '=' assign
binding = target{t(" '!'?")}{ann} ( '=' assign )?
target = id | object | array
func = 'async'? 'function' '*'? id?{t(" tparams?")} params{ann} block
params = '(' ( param ( ',' param )* ','? )? ')'
param = {t("decorator* ")}'...'?{t(" id*")} ( target | 'this' ){t(" '?'?")}{ann} ( '=' assign )?
class = {t("'declare'? 'abstract'? ")}'class' id?{t(" tparams?")} ( 'extends' lhs{t(" targs?")} )?{t(" ( 'implements' type ( ',' type )* )?")} '{{' member* '}}'
member = ';' | {t("decorator* ")}mod* '*'? key{t(" '?'? tparams?")} params{ann} {t("( block | ';' )", "block")} | {t("decorator* ")}mod* key{t(" ( '?' | '!' )?")}{ann} ( '=' assign )? ';' | 'static' block {t("| mod* '[' id ':' type ']' typeann ';'?")}
mod = {mods}
key = name | STR | NUM | '[' assign ']'
import = 'import' STR | 'import'{t(" 'type'?")} ( id ( ',' ( named | '*' 'as' id ) )? | named | '*' 'as' id ) 'from' STR ( 'with' object )? {t("| 'import' id '=' expr")}
named = '{{' ( spec ( ',' spec )* ','? )? ';'? '}}'
spec = {t("'type'? ")}( name | STR ) ( 'as' ( name | STR ) )?
export = 'export' ( decl | {t("'type'? ")}named ( 'from' STR )? | '*' ( 'as' name )? 'from' STR | 'default' assign0 )
expr = assign ( ',' assign )*
assign = operand ( binary operand )* ( '?' assign ':' assign ( binary operand )* )?
expr0 = assign0 ( ',' assign )*
assign0 = operand0 ( binary operand )* ( '?' assign ':' assign ( binary operand )* )?
operand0 = prefix+ ( primary postfix* | arrow ) | primary0 postfix* | arrow | 'yield' '*'? assign?
binary = '=' | '+' | '-' | '*' | '/' | '%' | '**' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '===' | '!==' | '&&' | '||' | '??' | '&' | '|' | '^' | '<<' | '>' '>' | '>' '>' '>' | '>' '>=' | '>' '>' '>='
  | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '&=' | '|=' | '^=' | '<<=' | '&&=' | '||=' | '??=' | 'in' | 'instanceof'
operand = prefix* primary postfix* | prefix* arrow | 'yield' '*'? assign?
prefix = '!' | '~' | '+' | '-' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' | 'new' {t("| '<' type '>'")}
arrow = 'async'? ( id |{t(" tparams?")} params{ann} ) '=>' ( block | assign0 | func | class )
primary = primary0 | object | func | {t("decorator* ")}class
primary0 = ID | {_choice(contextual - {"async", "yield", "await"})} | 'async' | NUM | STR | REGEX | template | '(' expr ')' | array | 'import' ( '(' assign ( ',' assign )? ','? ')' | '.' name )
template = TPL | TPL0 expr ( TPLM expr )* TPLE
postfix = ( '.' | '?.' ) name | '?.'? '[' expr ']' | '?.'? args | template | '++' | '--' | '.' 'target' {t("| '!' | 'as' ( type | 'const' ) | 'satisfies' type | targs ( args | template )")}
args = '(' ( arg ( ',' arg )* ','? )? ')'
arg = '...'? assign
array = '[' ( ','* arg ( ','+ arg )* ','* | ','+ )? ']'
object = '{{' ( prop ( ',' prop )* ','? )? ';'? '}}'
prop = '...' assign | ( 'async' | 'get' | 'set' )? '*'? key{t(" tparams?")} params{ann} block | key ':' assign | id ( '=' assign )?
""" + (
        f"""
decorator = '@' id ( '.' name )* args? ';'?
typeann = ':' type | ':' ( 'asserts' )? ( id | 'this' ) 'is' type
tparams = '<' tparam ( ',' tparam )* ','? '>'
tparam = ( 'const' | 'in' | 'out' )? id ( 'extends' type )? ( '=' type )?
targs = '<' type ( ',' type )* '>'
type = ( '|' | '&' )? single ( ( '|' | '&' ) single )* ( 'extends' type '?' type ':' type )? ( 'is' type )?
single = ( 'keyof' | 'readonly' | 'unique' | 'infer' )* atom ( '[' type? ']' )*
atom = ( name ( '.' name )* | 'import' '(' STR ')' ( '.' name )* ) targs? | STR | '-'? NUM | template | 'typeof' lhs | members | '[' ( '...'? ( id '?'? ':' )? type '?'? ( ',' '...'? ( id '?'? ':' )? type '?'? )* ','? )? ']' | '(' type ')' | 'abstract'? 'new'? tparams? params '=>' type
members = '{{' tmember* '}}'
tmember = ( 'readonly' | 'get' | 'set' | '-' | '+' )* ( key '?'? ( typeann | tparams? params typeann? )? | 'new'? tparams? params typeann? | '[' id ( ':' | 'in' ) type ( 'as' type )? ']' ( '-' | '+' )? '?'? typeann ) ( ';' | ',' )? | ';'
heritage = ( 'extends' type ( ',' type )* )?
tsfull = 'declare'? ( 'interface' id tparams? heritage members | 'const'? 'enum' id '{{' ( enumerator ( ',' enumerator )* ','? )? ';'? '}}' | ( 'namespace' | 'module' ) ( id ( '.' id )* | STR ) block )
enumerator = key ( '=' assign )?
"""
        if ts
        else ""
    )


GO = """
file = 'package' ID ';' ( import ';' )* ( top ';' )*
import = 'import' ( spec | '(' ( spec ';' )* spec? ')' )
spec = ( ID | '.' )? STR
top = func | decl
func = 'func' ( params )? ID tparams? params result? block?
decl = 'const' group | 'var' group | 'type' ( typespec | '(' ( typespec ';' )* typespec? ')' )
group = vspec | '(' ( vspec ';' )* vspec? ')'
vspec = ID ( ',' ID )* type? ( '=' exprs )?
typespec = ID tparams? '='? type
tparams = '[' ID ( ',' ID )* constraint ( ',' ID ( ',' ID )* constraint )* ','? ']'
constraint = '~'? type ( '|' '~'? type )*
params = '(' ( param ( ',' param )* ','? )? ')'
param = type | ID '...'? type | '...' type
result = type | params
block = '{' stmts '}'
stmts = ( stmt ( ';' stmts )? | ';' stmts )?
stmt = simple | decl | block | 'return' exprs? | 'break' ID? | 'continue' ID? | 'goto' ID | 'fallthrough' | 'go' cexpr | 'defer' cexpr | if | for | switch | select | ID ':' stmt?
simple = exprs ( ( '=' | ':=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^=' ) exprs | '++' | '--' | '<-' cexpr )?
if = 'if' ( simple? ';' )? cexpr block ( 'else' ( if | block ) )?
for = 'for' ( cexpr | simple? ';' cexpr? ';' simple? | ( exprs ( '=' | ':=' ) )? 'range' cexpr )? block
switch = 'switch' ( simple? ';' )? ( simple )? '{' ( ( 'case' ( type ( ',' type )* | exprs ) | 'default' ) ':' stmts )* '}'
select = 'select' '{' ( ( 'case' simple | 'default' ) ':' stmts )* '}'
exprs = cexpr ( ',' cexpr )*
cexpr = operand ( ( '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>>' | '&^' | '&&' | '||' | '==' | '!=' | '<' | '<=' | '>' | '>=' ) operand )*
operand = ( '+' | '-' | '!' | '^' | '*' | '&' | '<-' )* primary postfix*
primary = ID | NUM | STR | '(' ( cexpr | type ) ')' | 'func' params result? block | '[' ( cexpr | '...' )? ']' type | 'map' '[' type ']' type | 'struct' fields | 'interface' methods | 'chan' type
postfix = '.' ( ID | '(' ( type | 'type' ) ')' ) | '[' ( cexpr? ( ':' cexpr? )? ( ':' cexpr )? | type ( ',' type )* ) ']' | '(' ( ( cexpr | type ) ( ',' ( cexpr | type ) )* '...'? ','? )? ')' | literal
literal = '{' ( element ( ',' element )* ','? )? '}'
element = ( ( cexpr | literal ) ':' )? ( cexpr | literal )
type = ID ( '.' ID )? ( '[' type ( ',' type )* ']' )? | '*' type | '[' ( cexpr | '...' )? ']' type | 'map' '[' type ']' type | 'chan' '<-'? type | '<-' 'chan' type | 'func' params result? | 'struct' fields | 'interface' methods | '(' type ')'
fields = '{' ( field ';' )* field? '}'
field = ( ID ( ',' ID )* type | '*'? ID ( '.' ID )? ) STR?
methods = '{' ( method ';' )* method? '}'
method = ID params result? | constraint
"""

_JAVA_SOFT = {"record", "sealed", "permits", "non", "yield", "var"}
_JAVA_MODS = {"public", "private", "protected", "static", "final", "abstract", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed"}
JAVA = f"""
file = ( annotation* 'package' qname ';' )? ( 'import' 'static'? qname ( '.' '*' )? ';' | ';' )* ( typedecl | ';' )*
id = ID | {_choice(_JAVA_SOFT)}
qname = id ( '.' id )*
annotation = '@' qname ( '(' ( aval ( ',' aval )* )? ')' )?
aval = ( id '=' )? ( expr | annotation | '{{' ( ( expr | annotation ) ( ',' ( expr | annotation ) )* ','? )? '}}' )
mod = annotation | {_choice(_JAVA_MODS)} | 'non' '-' 'sealed'
typedecl = mod* ( class | interface | enum | record | '@' 'interface' id body )
class = 'class' id tparams? ( 'extends' type )? ( 'implements' types )? ( 'permits' types )? body
interface = 'interface' id tparams? ( 'extends' types )? ( 'permits' types )? body
record = 'record' id tparams? params ( 'implements' types )? body
enum = 'enum' id ( 'implements' types )? '{{' ( constant ( ',' constant )* ','? )? ( ';' member* )? '}}'
constant = annotation* id args? body?
body = '{{' member* '}}'
member = ';' | 'static'? block | typedecl | mod* tparams? ( type | 'void' ) id params dims ( 'throws' types )? ( 'default' aval )? ( block | ';' ) | mod* tparams? id params? ( 'throws' types )? block | mod* type vars ';'
dims = ( '[' ']' )*
vars = var ( ',' var )*
var = id dims ( '=' init )?
init = expr | '{{' ( init ( ',' init )* ','? )? '}}'
tparams = '<' tparam ( ',' tparam )* '>'
tparam = annotation* id ( 'extends' type ( '&' type )* )?
types = type ( ',' type )*
type = annotation* id targs? ( '.' annotation* id targs? )* ( annotation* '[' ']' )*
targs = '<' ( targ ( ',' targ )* )? '>'
targ = '?' ( ( 'extends' | 'super' ) type )? | type
params = '(' ( param ( ',' param )* )? ')'
param = mod* type '...'? ( id dims | 'this' )
block = '{{' stmt* '}}'
stmt = ';' | block | mod* type vars ';' | typedecl | expr ';' | 'if' '(' expr ')' stmt ( 'else' stmt )? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
  | 'for' '(' ( ( mod* type vars | expr ( ',' expr )* )? ';' expr? ';' ( expr ( ',' expr )* )? | mod* type id ':' expr ) ')' stmt | 'return' expr? ';' | 'throw' expr ';' | 'break' id? ';' | 'continue' id? ';'
  | 'switch' '(' expr ')' switchbody | 'try' ( '(' resource ( ';' resource )* ';'? ')' )? block ( 'catch' '(' mod* type ( '|' type )* id ')' block )* ( 'finally' block )? | 'synchronized' '(' expr ')' block | 'assert' expr ( ':' expr )? ';' | id ':' stmt | 'yield' expr ';'
resource = mod* type id '=' expr | expr
switchbody = '{{' ( label ':' stmt* )* '}}' | '{{' ( label '->' ( expr ';' | block | 'throw' expr ';' ) )* '}}'
label = 'case' ( 'null' | ternary | type id | 'default' ) ( ',' ( ternary | 'default' ) )* ( 'when' expr )? | 'default'
expr = ternary ( assignop ternary )*
assignop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>='
ternary = lambda | binary ( '?' ternary ':' ternary )?
lambda = ( id | '(' ( id ( ',' id )* )? ')' | params ) '->' ( expr | block )
binary = operand ( ( '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '&&' | '||' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '>' '>' '>' ) operand | 'instanceof' 'final'? type id? )*
operand = ( '+' | '-' | '!' | '~' | '++' | '--' | '(' type ( '&' type )* ')' )* primary postfix* | '(' type ( '&' type )* ')' lambda
primary = id | NUM | STR | '(' expr ')' | 'new' annotation* qname targs? ( '.' id targs? )* ( args body? | ( '[' expr? ']' )+ ( '{{' ( init ( ',' init )* ','? )? '}}' )? ) | 'switch' '(' expr ')' switchbody | type '::' ( id | 'new' ) | 'void' '.' 'class' | type '.' 'class'
postfix = '.' ( targs? id | 'class' | 'new' id targs? args body? ) | '[' expr ']' | args | '++' | '--' | '::' ( id | 'new' )
args = '(' ( expr ( ',' expr )* )? ')'
"""

_PY_SOFT = {"match", "case", "type"}
PYTHON = f"""
file = stmt*
id = ID | {_choice(_PY_SOFT)}
stmt = simple ( ';' simple )* ';'? NEWLINE | compound
simple = 'pass' | 'break' | 'continue' | 'return' exprs? | 'raise' ( test ( 'from' test )? )? | 'import' dotted ( 'as' id )? ( ',' dotted ( 'as' id )? )*
  | 'from' ( ( '.' | '...' )+ dotted? | dotted ) 'import' ( '*' | names | '(' names ','? ')' ) | ( 'global' | 'nonlocal' ) id ( ',' id )* | 'del' exprs | 'assert' test ( ',' test )? | 'type' id tparams? '=' test
  | exprs | targets '=' assigned | place ( aug ( exprs | 'yield' yielded? ) | ':' test ( '=' ( exprs | 'yield' yielded? ) )? ) | 'yield' yielded?
assigned = exprs | 'yield' yielded? | targets '=' assigned
targets = '*'? place ( ',' '*'? place )* ','?
place = id postfix* | ( NUM | STR+ | '{{' ( star ( ':' test pairs | for+ | ( ',' star )* ','? ) | '**' operand pairs )? '}}' ) postfix+ | '(' targets? ')' | '[' targets? ']' | ( '(' ( 'yield' yielded? | items )? ')' | '[' items? ']' ) postfix+
aug = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='
yielded = exprs | 'from' test
dotted = id ( '.' id )*
names = id ( 'as' id )? ( ',' id ( 'as' id )? )*
compound = 'if' named ':' suite ( 'elif' named ':' suite )* ( 'else' ':' suite )? | 'while' named ':' suite ( 'else' ':' suite )? | 'async'? 'for' exprs0 'in' exprs ':' suite ( 'else' ':' suite )?
  | 'try' ':' suite ( ( 'except' '*'? ( exprs ( 'as' id )? )? ':' suite )+ ( 'else' ':' suite )? ( 'finally' ':' suite )? | 'finally' ':' suite )
  | 'async'? 'with' ( item ( ',' item )* | '(' item ( ',' item )* ','? ')' ) ':' suite | decorated
  | 'match' exprs ':' NEWLINE INDENT ( 'case' pattern ( 'if' named )? ':' suite )+ DEDENT
decorated = ( '@' named NEWLINE )* ( 'async'? 'def' id tparams? '(' params? ')' ( '->' exprs )? ':' suite | 'class' id tparams? ( '(' args? ')' )? ':' suite )
tparams = '[' ( '*' | '**' )? id ( ':' test )? ( ',' ( '*' | '**' )? id ( ':' test )? )* ','? ']'
item = test ( 'as' star )?
pattern = exprs ( 'as' id )?
suite = simple ( ';' simple )* ';'? NEWLINE | NEWLINE INDENT stmt+ DEDENT
params = ( plain ( ',' plain )* ( ',' given ( ',' given )* )? ( ',' ptail )? | given ( ',' given )* ( ',' ptail )? | ptail ) ','?
plain = id ( ':' star )? | '/'
given = id ( ':' star )? '=' test | '/'
ptail = ( '*' id? ( ':' star )? ( ',' id ( ':' star )? ( '=' test )? )* ( ',' '**' id ( ':' star )? )? ) | '**' id ( ':' star )?
exprs = star ( ',' star )* ','?
star = '*'? named
named = test ( ':=' test )?
test = lambda | or ( 'if' or 'else' test )?
lambda = 'lambda' ( lparam ( ',' lparam )* ','? )? ':' test
lparam = ( id | '*' id? | '**' id | '/' ) ( '=' test )?
or = operand ( ( 'or' | 'and' | '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' | 'is' 'not' | '|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '%' | '//' | '@' | '**' ) operand )*
operand = ( 'not' | '+' | '-' | '~' | 'await' )* primary postfix*
primary = id | NUM | STR+ | '...' | '(' ( 'yield' yielded? | items )? ')' | '[' items? ']' | '{{' ( star ( ':' test pairs | for+ | ( ',' star )* ','? ) | '**' operand pairs )? '}}'
items = star ( for+ | ( ',' star )* ','? )
pairs = for+ | ( ',' ( test ':' test | '**' operand ) )* ','?
for = 'async'? 'for' exprs0 'in' or ( 'if' ( or | lambda ) )*
exprs0 = target ( ',' target )* ','?
target = '*'? primary postfix*
postfix = '.' id | '(' args? ')' | '[' slice ( ',' slice )* ','? ']'
args = ( parg ( ',' parg )* ( ',' karg ( ',' ( karg | '*' test ) )* )? | karg ( ',' ( karg | '*' test ) )* ) ','?
parg = '*' test | named for*
karg = id '=' test | '**' test
slice = star ( ':' test? ( ':' test? )? )? | ':' test? ( ':' test? )?
"""

_RB_NAMES = RB_KEYWORDS - {"defined?", "BEGIN", "END"}
#: Expressions are flat: a name applied to operands without brackets counts as one more operator,
#: so each token leaves few stacks. NL stands for line ends and semicolons.
RUBY = f"""
program = stmts
stmts = NL? seq?
seq = stmt ( NL seq? )?
stmt = ( flat0 | 'alias' aname aname | 'undef' aname ) modifier*
aname = ID | CONST | SYM | IVAR
modifier = ( 'if' | 'unless' | 'while' | 'until' | 'rescue' ) flat
flat0 = prefix0* ( basen tailn | basec tailc )
flat = prefix* ( basen tailn | basec tailc ) | LABEL ( op flat )?
tailn = ( postn tailn | dot tailc | op flat )?
tailc = ( postn tailn | dot tailc | op flat | juxt )?
juxt = jbase tailn | basec tailc | prefix+ ( jbase tailn | basec tailc | '{{' list '}}' tailn ) | LABEL
op = '=' | '+' | '-' | '*' | '/' | '%' | '**' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '===' | '<=>' | '=~' | '!~' | '&&' | '||' | '&' | '|' | '^' | '<<' | '>>' | '..' | '...'
  | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&&=' | '||=' | 'and' | 'or' | '?' | ':' | ',' | '=>'
prefix0 = '!' | '-' | '+' | '~' | '&' | '*' | '**' | '::' | 'not' | 'defined?' | '..'
prefix = prefix0 | LABEL
basec = ID | CONST | 'yield' | 'super' | 'return' | 'next' | 'break' | 'redo' | 'retry'
basen = jbase | '{{' list '}}' | 'if' flat then stmts ( 'elsif' flat then stmts )* ( 'else' stmts )? 'end' | 'unless' flat then stmts ( 'else' stmts )? 'end' | ( 'while' | 'until' ) flat 'do'? stmts 'end'
jbase = NUM | STR+ | SYM | IVAR | REGEX | '(' stmts ')' | '[' list ']' | '->' ( ( '(' | CALL ) flat? ')' | ID )? block
  | 'for' flat 'in' flat 'do'? stmts 'end' | 'case' flat? NL? ( ( 'when' | 'in' ) flat then stmts )+ ( 'else' stmts )? 'end' | 'begin' body 'end' | 'class' ( flat | '<<' flat ) body 'end' | 'module' flat body 'end' | 'def' def
then = NL? 'then'?
list = NL? ( flat ( NL? ',' )? )? NL?
dot = ( '.' | '&.' | '::' ) name
postn = CALL list ')' | INDEX list ']' | block
name = ID | CONST | IVAR | {_choice(_RB_NAMES)} | '+' | '-' | '*' | '/' | '==' | '<' | '>' | '<<' | '!'
block = '{{' bparams? stmts '}}' | 'do' bparams? body 'end'
bparams = '|' ( bparam ( ',' bparam )* ','? )? '|' | '||'
bparam = ( '*' | '**' | '&' )? ID ( '=' flat )? | LABEL | '*' | '(' bparam ( ',' bparam )* ')'
body = stmts ( 'rescue' flat? ( '=>' flat )? 'then'? stmts )* ( 'else' stmts )? ( 'ensure' stmts )?
def = ( ( ID | CONST | IVAR ) '.' )? dname ( ( '(' | CALL ) list ')' )? ( '=' flat | body 'end' )
dname = ( ID | CONST | {_choice(_RB_NAMES)} ) '='? | '+' | '-' | '*' | '/' | '%' | '==' | '<=>' | '<' | '>' | '<=' | '>=' | '<<' | '>>' | '!' | '[' ']' '='? | INDEX ']' '='? | '=~' | '===' | '~'
"""

_SOURCES = {
    "json": (JSON, "top"), "go": (GO, "file"), "java": (JAVA, "file"), "python": (PYTHON, "file"), "ruby": (RUBY, "program"),
}


@cache
def grammar(language: str) -> Grammar:
    """The grammar of a language, with its memo; one per process."""
    if language in ("javascript", "typescript"):
        return Grammar(_javascript(language == "typescript"), "program")
    return Grammar(*_SOURCES[language])


def check(language: str, text: str) -> tuple[str, int, Tokens]:
    """Verdict (``ok``, ``error`` or ``truncated``), index of the failing token, and the tokens."""
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    found = tokens(language, text)
    verdict, at = grammar(language).parse(found[0])
    if verdict == "error" and found[0][at] != "BAD" and not text[found[1][at] :].strip():
        verdict = "truncated"  # the failing token is the end of the last line
    return verdict, at, found


