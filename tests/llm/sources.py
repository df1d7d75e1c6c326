"""Short sources that are valid or broken in their language, for the tests of problem 1."""

VALID = {
    'go': [
        'package a\n\ntype T struct {\n\tA int `json:"a"`\n\tB *x.Y\n\tio.Reader\n}\n',
        'package a\n\nfunc f() { return }\n',
        'package a\n\nfunc f[T any](x T) (int, error) {\n\tm := map[string][]int{"a": {1, 2}}\n\tfor k, v := range m {\n\t\tgo func() { x <- v[1:2] }()\n\t}\n\tswitch y := x.(type) {\n\tcase int, string:\n\t\tfallthrough\n\tdefault:\n\t\treturn 0, nil\n\t}\n\tselect {\n\tcase v := <-c:\n\t\t_ = v\n\t}\n\tif a, ok := m["k"]; ok && a != nil {\n\t} else if !ok {\n\t} else {\n\t}\nouter:\n\tfor {\n\t\tbreak outer\n\t}\n\treturn &T{A: 1}, err\n}\n',
        'package a\n\nconst (\n\tA = iota\n\tB\n)\n\nvar x, y int = 1, 2\n\ntype I interface {\n\tM(a int) error\n\t~int | string\n}\n\ntype F func(int, ...string) (a, b int)\n\nvar z = []struct{ n int }{{1}, {2}}\n',
        'package a\n\nimport (\n\t"a/b"\n\tc "d"\n\t. "e"\n)\n\nfunc (s *S[T]) m(a, b int, c ...string) {\n\tx := func(a int) int { return a * 2 }(3)\n\tch <- x\n\tvar p **int\n\t*p = &x\n\tdefer close(ch)\n\ta[i], b = b, a[j]\n\tx++\n}\n',
    ],
    'java': [
        'package a;\n\npublic sealed interface S permits A, B {}\n',
        'class A {\n    String f(Object o) {\n        switch (o) {\n            case String s when s.isEmpty() -> { return s; }\n            case Integer i -> throw new X();\n            default -> { }\n        }\n        return null;\n    }\n}\n',
        'package a;\n\n@Retention(R.RUNTIME)\npublic @interface N {\n    String value() default "x";\n    int[] ids() default {1, 2};\n}\n',
        'import java.util.*;\nimport static a.B.c;\n\npublic class A<T extends Comparable<T>> extends B<Map<String, List<T>>> implements C, D {\n    private final Map<String, List<Integer>> m = new HashMap<>();\n    enum E { X(1) { void g() {} }, Y; int a; E() {} }\n    static { init(); }\n    public A(int... xs) throws IOException { super(xs); this.x = xs[0]; }\n    @Override\n    public <R> R f(final T t, @N int[] a) {\n        Runnable r = () -> run();\n        Function<T, R> g = x -> { return h(x); };\n        List<?> q = (List<? extends T>) t;\n        int[][] z = new int[3][4], w = {{1}, {2}};\n        for (Map.Entry<String, Integer> e : m.entrySet()) { a.b(e::get, String[]::new, int.class); }\n        do { i--; } while (i > 0);\n        try (Reader in = open(); Writer out = w()) { } catch (A | B e) { } finally { }\n        synchronized (this) { x = y == 1 ? a : b; }\n        label: while (true) { break label; }\n        assert x > 0 : "m";\n        if (o instanceof String s && s.length() > 2) return (R) s;\n        return new Object() { int k; public int hashCode() { return 1; } };\n    }\n    record P(int x, int y) { P { check(x); } }\n}\n',
        'class A { int f() { return switch (x) { case 1, 2 -> 3; default -> { yield 4; } }; } }\n',
    ],
    'javascript': [
        'try { f(); } catch { g(); }\n',
        'function f(x) { return /a[/]b/.test(x) }\n',
        'var i = 0;\ndo { i++ } while (i < 3)\nf(i);\n',
        'async function f(xs) { for await (const x of xs) { g(x); } }\n',
        'const t = `a ${ `b ${c} d` } e`;\n',
        "import a, { b as c, d } from './e';\nexport default class extends A { #p = 1; static s = 2; get x() { return this.#p } async *g() { yield* h(); } static { init() } constructor() { super() } [k]() {} }\nexport { a as default, b };\nexport * from 'x';\nexport const z = async ({ a, b: [c] = [], ...r }, d = 1) => ({ ...r, [a]: c, 'k': 1, get q() { return 1 }, m() {}, async n() {} });\n",
        "switch (x) { case 1: case 'a': { f(); break } default: g() }\nlabel: for (let i = 0, n = a.length; i < n; i++) { if (i in o) continue label; else h(i) }\nfor (;;) { break }\nfor (const k in o) f(k)\nlet [p, , q] = r, { s, t: u } = v\nx ??= a?.b?.[c]?.(d) ?? e\nvar re = a / b / c, y = x => x ? 1 : y => 2\nnew (foo())()\ndelete a.b, void 0, typeof x === 'y'\nif (a) b(); else if (c) d(); else { e() }\nthrow new Error(`x${1}`)\n",
        "(function () { 'use strict'; var a = [1, 2, , 3,]; })();\n(() => {})();\n!function () {}();\n",
        'while (x) x--\nvar f = async x => await x, g = function* () { yield }\nvar o = { if: 1, class: 2, async: 3, get: 4 }\nif (x) { } else y = 1\n',
    ],
    'typescript': [
        'abstract class A<T extends B = C> extends D<T> implements E, F {\n  private readonly x: number = 1;\n  declare y?: string;\n  constructor(private a: string, public b?: number) { super(); }\n  abstract f(x: T): Promise<void>;\n  get z(): string { return this.x as unknown as string; }\n  static async g<K extends keyof T>(k: K, ...r: T[K][]): Promise<Array<Map<K, T>>> { return await h<T>(k!, r); }\n  [key: string]: any;\n}\n',
        "interface I extends J<K> {\n  a: string;\n  b?(x: number): void;\n  readonly c: { d: number, e: [string, number?] };\n  (x: number): string;\n  new (x: number): I;\n}\ntype U = 'a' | 'b' | { k: 1 };\ntype F = (a: number, ...b: string[]) => a is string;\ntype M = { readonly [P in keyof T]?: T[P] };\ntype C = T extends (infer U)[] ? U : never;\nenum E { A = 1, B = 'x', C }\ndeclare module 'x' { export function f(a: number): string; }\nnamespace N { export const x = 1; }\nexport type { U } from './u';\nimport type { V } from './v';\nlet v: Array<string | undefined> = [], w = <T,>(x: T): T => x;\nfunction isS(x: any): x is string { return typeof x === 'string'; }\nconst q = { a: 1 } as const;\nfor (const [k, v2] of Object.entries(q)) { f(k, v2!); }\n@Comp({ sel: 'x' })\nexport class D { @Input() p: string; m = (e: Event): void => { this.p = ''; }; }\n",
    ],
    'c': [
        'static const int t[] = { [2 ... 4] = 1, [A] = 2 };\n',
        'int f(a, b)\n    int a;\n    char *b;\n{\n    return a;\n}\n',
        '#include <a.h>\n#define X(a) do { a; } while (0)\ntypedef struct node { int v; struct node *next; unsigned f : 3; } node_t;\nenum e { A, B = 2, C };\nextern int g(const char *, ...);\nstatic void (*handlers[3])(int, void *) = { a, b, c };\nint main(int argc, char **argv)\n{\n    struct s x = { .a = 1, .b = { 2, 3 } }, *p = &x;\n    size_t n = sizeof(struct s) * 2, i;\n    for (int i = 0; i < 3; i++) { if (a[i]) continue; else break; }\n    switch (x.a) { case 1: case \'c\': f("a" "b" PRIu64); break; default: goto out; }\n    do { p->a--; } while (p->a > 0 && !*q);\n    y = (unsigned char)z ? a : b;\n    f((struct s){ .a = 1 }, (int *)p);\nout:\n    return (x.a << 2) | ~y;\n}\n',
        'union u { int a; float b; };\nint a, *b, c[3][4];\nunsigned long long x = 1ULL;\nint (*fp)(void);\nvoid g(void) { while (*p++) ; int z = -1; a = b = c; }\n',
    ],
    'python': [
        "x = 1\nmatch = 2\ndef f(a, /, b, *, c=1, **k): pass\nasync def g():\n    async with a as b, c: await d\n    return [x async for x in y if x]\nwith (open(a) as b, open(c)): pass\n@a.b(1)\nclass C(D, metaclass=E):\n    x: int = 1\n    def f(self) -> 'x': ...\ntry:\n    a\nexcept (A, B) as e: raise X from e\nelse:\n    b\nfinally:\n    c\nprint(f'{a!r}', *b, sep='', **d)\nif (n := 1) > 0: a[1:2, ::3] = {**x, 'a': 1}\n",
    ],
}

BROKEN = {
    'c': [
        'int f(void) { return 0 }\n',
        'int f(void) { foo(a b); }\n',
        'class A { public: int x; };\n',
        'int f(void) { int x = ; }\n',
        'int f(void) { if x > 1 { g(); } }\n',
        'int f(void) { for (int i = 0; i < 3) { g(); } }\n',
        'int f(void) { g(1,, 2); }\n',
        'int f(void) { a[1; }\n',
        'int f(void) { g(a b c(d e)); }\n',
        'int f(void {\n  return 1;\n}\n',
        'int f(void) { g((((((((((a b)))))))))); }\n',
    ],
    'java': [
        'class A { int f() { return 0 } }\n',
        'class A { void f() { foo(a b); } }\n',
        'class A { void f() { for (int i = 0; i < 3) {} } }\n',
        'class A { void f() { int x = 1 } }\n',
        'class A { void f() { if x { } } }\n',
        'class A { void f( { } }\n',
        'class A { void f() { x = = 1; } }\n',
        'public class A {\n<<<<<<< HEAD\n int a;\n=======\n int b;\n>>>>>>> x\n}\n',
        'class A { void f() { g(h(i(j(k(l(m(n o))))))); } }\n',
    ],
    'javascript': [
        'for (let i = 0; i < 3) {}\n',
        'const x;\n',
        'foo(a b);\n',
        'var x = ;\n',
        'function (a) { }\n',
        'if x { }\n',
        'var a = { b: 1 c: 2 };\n',
        'let = 3 4;\n',
        'foo(;\n',
        'return }\n',
        'function f(a { }\n',
        '{"a": 1, "b": 2}\n',
        'x = [1, 2;\n',
        'var f = function { };\n',
    ],
    'typescript': [
        'const x: number;\nfoo(a b);\n',
        'function f(a: string {\n}\n',
        'let x: = 3;\n',
        'class A { f(x: number: string) { } }\n',
    ],
    'go': [
        'package a\n\nx := 1\n',
        'package a\n\nfunc f() {\n\tfoo(a b)\n}\n',
        'package a\n\nfunc f( {\n}\n',
        'package a\n\nfunc f() {\n\tx = = 1\n}\n',
        'package a\n\nfunc f() {\n\tif x == 1\n\t{\n\t}\n}\n',
        'package a\n\nfunc f() {\n\tvar x int y\n}\n',
        'import "a"\n\nfunc f() {}\n',
        'package a\n\nclass A {\n}\n',
    ],
    'python': [
        '1 = x\n',
        'f(a=1, b)\n',
        'def f(a, b=1, c): pass\n',
        'x++\n',
        'x = 0777\n',
        'x = {1: 2, 3}\n',
        'if x:\n  y\n z\n',
        'f() = 1\n',
        'def f(a, a b): pass\n',
        "print 'x'\n",
        'for x y in z: pass\n',
        'x = (1,\n',
        'class A\n  pass\n',
        'return = 1\n',
        'a b\n',
        'else:\n  x\n',
        'try:\n  x\n',
        'import a.\n',
        'from x import\n',
        'lambda: (yield) = 1\n',
        'x = 1 +\n',
        'def f(*): pass\n',
        'def f(**k, a): pass\n',
        "x = 'a\n",
        'if x = 1: pass\n',
        'f(**a, *b)\n',
        'del f()\n',
        'a, b += 1\n',
        'x: int: str\n',
        'with a as 1: pass\n',
        'for 1 in x: pass\n',
        '[x for x in]\n',
        '{a, b: c}\n',
        '@\ndef f(): pass\n',
        'def f():\nx\n',
        '  x\n',
        'x\n  y\n',
        'not = 1\n',
        'a = b = \n',
        'x = [1 2]\n',
        'while True print(x)\n',
        'async x = 1\n',
        'f(a for a in b, c)\n',
        'None = 1\n',
        'nonlocal\n',
        'x = 1 if y\n',
        'a.1\n',
        'a..b\n',
        'raise from x\n',
        'def f(x=): pass\n',
    ],
}
