"""Anti-patterns by language. Patterns, ids, severities and messages are fixed values: results are compared by them."""
from __future__ import annotations

from tessella.operators.rules import Group, Rule
from tessella.plans.packs import NOT_SOURCE


def _group(name: str, extensions: str, rows: tuple, quotes: bool = False, every: bool = True) -> Group:
    """Rows: pattern, id, severity, message, fix id, exclusions..."""
    return Group(f"{name}-patterns", "patterns", extensions=tuple(extensions.split()), quotes=quotes, every=every, rules=tuple(Rule(p, m, id="patterns/" + i, severity=s, fix_id=f, unless=tuple(x)) for p, i, s, m, f, *x in rows))


# fixed values: placeholders of all languages; comments count, and the message ends with the line
PLACEHOLDER = Group(
    "placeholder", "patterns", id="patterns/todo-placeholder", comments=True, quotes=True, skip=NOT_SOURCE,
    rules=tuple(Rule(p, "TODO or placeholder left in code: ", severity="warning", suggestion="Implement the functionality or remove the placeholder before committing") for p in (
        r"(?i)//\s*TODO\b", r"(?i)#\s*TODO\b", r"(?i)raise\s+NotImplementedError", r"(?i)throw\s+new\s+Error\(\s*['\"]not\s+implemented", r"panic\(\s*\"not implemented\"", r"\btodo!\(", r"\bunimplemented!\(",
    )),
)
PYTHON_PASS = Group(
    "python-pass", "patterns", id="patterns/todo-placeholder", extensions=(".py",), comments=True,
    rules=(Rule(r"^\s*pass\s*$", "Standalone 'pass' statement may be a placeholder", severity="warning"),),
)
CREDENTIAL = Group(
    "credential", "patterns", id="patterns/hardcoded-credential", skip=NOT_SOURCE,
    unless=(r"(?i)password\s*=\s*\"\"\s*$", r"(?i)secret\s*=\s*\"\"\s*$", r"(?i)os\.Getenv\(.*password", r"(?i)os\.Getenv\(.*secret", r"(?i)password\s*=\s*\"\$\{", r"(?i)secret\s*=\s*\"\$\{", r"(?i)password\s*=\s*\"<[^>]*>\"", r"(?i)secret\s*=\s*\"<[^>]*>\"", r"(?i)(password|secret)\s*=\s*\"(test|example|dummy)\""),
    rules=tuple(Rule(p, "Possible hardcoded credential detected", severity="error") for p in (r"(?i)[\"']sk-[a-zA-Z0-9]{20,}[\"']", r"(?i)[\"']AKIA[A-Z0-9]{16}[\"']", r"(?i)[\"']ghp_[a-zA-Z0-9]{36,}[\"']", r"(?i)password\s*=\s*\"[^\"]+\"", r"(?i)secret\s*=\s*\"[^\"]+\"")),
)
TYPESCRIPT = _group("ts", ".ts .tsx", (
    (r"@ts-ignore|@ts-nocheck", "ts-ignore", "warning", "TypeScript suppression directive: ", "ts-remove-ignore"), (r"^///\s*<reference\s+", "ts-triple-slash", "info", "Triple-slash directive should be an import: ", ""),
    (r":\s*any\b|\bas\s+any\b|<any>", "ts-any-type", "warning", "Usage of `any` type reduces type safety: ", "ts-any-to-unknown"), (r"\w+!\.[a-zA-Z]", "ts-non-null-assertion", "warning", "Non-null assertion operator (!) may hide null safety issues: ", ""),
    (r"interface\s+\w+\s*\{\s*\}", "ts-empty-interface", "info", "Empty interface: ", ""),
), quotes=True)
TYPESCRIPT = Group(**(TYPESCRIPT.__dict__ | {"comments": True}))
JAVA = _group("java", ".java", ((r"\bcatch\s*\([^)]*\)\s*\{\s*\}", "empty-catch", "warning", "Empty catch block silently swallows exception", ""),))
JAVA_EQUALS = _group("java-equals", ".java", ((r"\b(\w+)\s*[!=]=\s*\"[^\"]*\"", "string-equals", "warning", "String comparison using == instead of .equals(): ", ""),), quotes=True)
RUST = _group("rust", ".rs", (
    (r"\.unwrap\(\)", "rust-unwrap", "warning", "Calling .unwrap() may panic at runtime: ", ""), (r"\.expect\(\"[^\"]*\"\)", "rust-expect", "warning", "Calling .expect() may panic at runtime: ", ""), (r"\.clone\(\)", "rust-unnecessary-clone", "warning", "Potentially unnecessary .clone() call: ", ""),
), quotes=True, every=False)
CSHARP = _group("csharp", ".cs", (
    (r"\bSystem\.Diagnostics\.Debug\.Write(Line)?\(", "console-debug", "warning", "Debug.WriteLine left in code: ", "csharp-debug-trace"), (r"#pragma\s+warning\s+disable\b", "pragma-disable", "warning", "#pragma warning disable without corresponding restore: ", ""),
), quotes=True, every=False)
CSHARP = Group(**(CSHARP.__dict__ | {"comments": True}))
PHP = _group("php", ".php", ((r"\berror_reporting\s*\(\s*0\s*\)", "php-error-suppression", "warning", "Error reporting disabled with error_reporting(0): ", ""), (r"@\$", "php-error-suppression", "warning", "Error suppression operator (@) hides errors: ", "")), quotes=True, every=False)
SWIFT = _group("swift", ".swift", ((r"\bfatalError\(", "swift-fatal-error", "warning", "fatalError() will crash the application at runtime: ", ""), (r"#if\s+DEBUG", "swift-debug-block", "warning", "#if DEBUG block may contain code not intended for production: ", "")), quotes=True, every=False)
C = _group("c", ".c .h .cpp .cc .cxx .hpp .hxx", ((r"\bgoto\s+", "c-goto", "warning", "goto statement detected — reduces code readability and maintainability: ", ""),), quotes=True)
ZIG = _group("zig", ".zig", (
    (r"\bcatch\s+unreachable\b", "zig-catch-unreachable", "warning", "catch unreachable will panic on error — handle errors explicitly", ""), (r"_\s*=.*catch\b", "zig-ignored-error", "warning", "Error union result assigned to _ — error silently ignored", ""), (r"std\.debug\.print\b", "zig-debug-print", "warning", "std.debug.print left in code — likely a debugging artifact", "zig-debug-print"),
))
NIM = _group("nim", ".nim", ((r"^\s*discard\s+", "nim-discard", "warning", "discard may hide important return values or errors", ""),))
CRYSTAL = _group("crystal", ".cr", (
    (r"\bpp\b", "crystal-debug-print", "warning", "pp debug call left in code", "crystal-debug-print"), (r"\.not_nil!", "crystal-not-nil-bang", "warning", ".not_nil! will raise at runtime if value is nil", ""), (r"\buninitialized\b", "crystal-uninitialized", "warning", "uninitialized creates unsafe memory — value is not zero-initialized", ""),
))
VLANG = _group("vlang", ".v", (
    (r"\bunsafe\s*\{", "vlang-unsafe", "warning", "unsafe block bypasses V's safety guarantees", ""), (r"or\s*\{\s*panic\s*\(", "vlang-or-panic", "warning", "or { panic(err) } pattern crashes on error instead of handling it", ""), (r"\[manualfree\]", "vlang-manualfree", "warning", "[manualfree] attribute disables automatic memory management", ""),
))
DLANG = _group("dlang", ".d", (
    (r"\bgoto\s+\w+", "dlang-goto", "warning", "goto statement makes control flow harder to follow", ""), (r"\bdelete\s+", "dlang-delete", "warning", "delete is deprecated in D — use destroy() or let the GC handle it", ""),
    (r"GC\.disable\b", "dlang-gc-disable", "warning", "GC.disable() disables garbage collection — potential for memory leaks", ""),
))
FUNCTIONAL = (
    _group("haskell", ".hs .lhs", ((r"\b(head|tail)\s", "haskell-partial-function", "warning", "head/tail are partial functions", ""), (r"\bDebug\.Trace\b|trace\s", "haskell-debug-trace", "warning", "Debug.Trace left in code", "haskell-debug-trace"), (r"\bString\b", "haskell-string-type", "info", "Using String type", ""))),
    _group("clojure", ".clj .cljs .cljc", ((r"^\s+\(def\s", "clojure-nested-def", "warning", "def inside function creates mutable global state", ""), (r"Thread/sleep", "clojure-thread-sleep", "warning", "Thread/sleep blocks the current thread", ""))),
    _group("erlang", ".erl .hrl", ((r"\+\+\s*\[", "erlang-list-append", "info", "List concatenation (++) copies the left list", ""), (r"catch\s+_:_\s*->", "erlang-catch-all", "warning", "Catch-all clause hides unexpected errors", ""))),
    _group("fsharp", ".fs .fsx", ((r"\blet\s+mutable\b", "fsharp-mutable", "info", "Mutable binding reduces referential transparency", ""), (r"\bprintfn\b", "fsharp-printfn", "info", "printfn left in code", "fsharp-debug-print"))),
    _group("ocaml", ".ml .mli", ((r"\bObj\.magic\b", "ocaml-obj-magic", "error", "Obj.magic bypasses the type system", ""),)),
)
SCRIPTING = (
    _group("perl", ".pl .pm", ((r"\bopen\s*\(\s*\w+\s*,\s*\"[^\"]*\"\s*\)", "perl-two-arg-open", "warning", "Two-argument open is vulnerable to injection", ""), (r"\$(?:GLOBAL|main::)\w+", "perl-global-var", "info", "Global variable usage reduces encapsulation", ""))),
    _group("powershell", ".ps1 .psm1", ((r"(?i)\bWrite-Host\b", "powershell-write-host", "info", "Write-Host left in code", "powershell-debug-print"), (r"\$global:\w+", "powershell-global-var", "warning", "Global variable usage creates hidden state", ""))),
    _group("groovy", ".groovy .gvy", ((r"\bprintln\b", "groovy-println", "info", "println left in code", "groovy-debug-print"), (r"\.\s*getClass\s*\(\s*\)\.", "groovy-reflection", "warning", "Reflection via getClass() can bypass safety", ""))),
)
DOMAIN = (
    _group("julia", ".jl", ((r"\bglobal\s+\w+", "julia-global-var", "warning", "Global variable reduces performance", ""),)), _group("fortran", ".f90 .f95 .f .for", ((r"(?i)\bgoto\b", "fortran-goto", "warning", "GOTO makes control flow hard to follow", ""),)),
    _group("solidity", ".sol", ((r"\.call\s*[\({]", "solidity-unchecked-call", "warning", "Low-level .call() without checking return value", "", r"\(\s*bool\s+\w+\s*,"), (r"(?:=|return|==|!=|>=|<=|>|<)\s*\d{2,}", "solidity-magic-number", "info", "Magic number without named constant", "", r"constant|immutable"), (r"^\s*function\s+\w+", "solidity-missing-event", "info", "State-changing function without event emission", "", r"view|pure|\bemit\s+\w+"))),
    _group("terraform", ".tf", ((r"ami\s*=\s*\"ami-[a-f0-9]+\"", "terraform-hardcoded-ami", "info", "Hardcoded AMI ID may be region-specific", ""),)),
    _group("protobuf", ".proto", ((r"\[deprecated\s*=\s*true\]", "protobuf-deprecated-field", "info", "Field marked as deprecated", ""), (r"^\s*repeated\s+.*=\s*(?:1[6-9]|[2-9]\d|\d{3,})\s*;", "protobuf-high-field-number", "info", "Repeated field with number > 15 uses less efficient encoding", ""))),
    _group("vb", ".vb .vbs", ((r"(?i)\bOn\s+Error\s+Resume\s+Next\b", "vb-on-error-resume-next", "warning", "On Error Resume Next silently ignores all errors", ""),)), _group("cobol", ".cob .cbl", ((r"(?i)\bGO\s*TO\b", "cobol-goto", "warning", "GO TO makes control flow hard to follow", ""),)),
    _group("ada", ".adb .ads", ((r"(?i)\bgoto\b", "ada-goto", "warning", "goto makes control flow hard to follow", ""),)), _group("pascal", ".pas .pp", ((r"(?i)\bgoto\b", "pascal-goto", "warning", "goto makes control flow hard to follow", ""),)),
)

LANGUAGES = (TYPESCRIPT, JAVA, JAVA_EQUALS, RUST, CSHARP, PHP, SWIFT, C, ZIG, NIM, CRYSTAL, VLANG, DLANG, *FUNCTIONAL, *SCRIPTING, *DOMAIN)
ALL = (PLACEHOLDER, PYTHON_PASS, CREDENTIAL, *LANGUAGES)
