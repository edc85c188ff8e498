"""Security rules by language. Patterns, ids, severities and messages are fixed values: results are compared by them."""
from __future__ import annotations

from tessella.operators.rules import Group, Rule
from tessella.plans.packs import UNSECURED


def _group(name: str, extensions: str, rows: tuple, marks: str = "") -> Group:
    """Rows: pattern, id, severity, message, exclusions..."""
    return Group(f"{name}-security", "security", extensions=tuple(extensions.split()), marks=marks, skip=UNSECURED, rules=tuple(Rule(p, m, id="security/" + i, severity=s, unless=tuple(x), fix_id="sec-hardcoded-secret" if "hardcoded" in i else "") for p, i, s, m, *x in rows))


_CMD = "executes shell commands — verify input is not user-controlled"
_NOT_REAL = r"(?i)(test|example|dummy|fake|mock|sample|placeholder|changeme)"

# what comments begin with
SLASHES, HASH, DASHES, BANG, SEMICOLON, PERCENT, OCAML_MARK, QUOTE, COBOL_MARK = r"^\s*(//|/\*|\*)", r"^\s*#", r"^\s*--", r"^\s*!", r"^\s*;", r"^\s*%", r"^\s*\(\*", r"^\s*'", r"^\s*\*>"
PASCAL_MARK, SLASH_HASH = r"^\s*(//|\{|\(\*)", r"^\s*(#|//)"

# fixed values
JAVA = _group("java", ".java", (
    (r"DocumentBuilderFactory\.newInstance\(\)", "xxe", "error", "Potential XXE vulnerability: DocumentBuilderFactory without disabling external entities", r"setFeature"),
    (r"ObjectInputStream\s*\(", "deserialization", "error", "Potential insecure deserialization: ObjectInputStream on untrusted data"),
    (r"\.lookup\s*\(\s*[a-zA-Z]", "jndi-injection", "error", "Potential JNDI injection: lookup() with variable argument", r"\.lookup\s*\(\s*\"[^\"]*\"\s*\)"),
    (r"(?i)(password|passwd|secret|apiKey|api_key)\s*=\s*\"[^\"]{8,}\"", "hardcoded-secret", "error", "Hardcoded credential detected in Java code", r"(?i)=\s*\"\"\s*;", r"(?i)System\.getenv\(", r"(?i)System\.getProperty\(", _NOT_REAL),
))
RUST = _group("rust", ".rs", (
    (r"\bunsafe\s*\{", "rust-unsafe", "warning", "Unsafe block detected — requires manual review"), (r"\*\w+\s*\.", "rust-raw-pointer", "warning", "Possible raw pointer dereference"),
    (r"std::process::Command::new\(", "rust-command-injection", "warning", "Process command execution — verify input is not user-controlled"),
    (r"(?i)(?:let|const)\s+(?:mut\s+)?(?:secret|api_key|password|token)\s*(?::\s*&?str)?\s*=\s*\"[^\"]{8,}\"", "rust-hardcoded-secret", "error", "Possible hardcoded secret in Rust code", r"(?i)(CHANGEME|xxx|placeholder|example|dummy|test|mock)", r"std::env::var\("),
))
SCRIPT_EXECUTION = _group("ts-execution", ".ts .tsx .js .jsx .mjs .cjs", (
    (r"\beval\s*\(", "code-execution", "error", "Unsafe code execution: eval()", r"(?i)(json\.parse|JSON\.parse)"), (r"new\s+Function\s*\(", "code-execution", "error", "Unsafe code execution: new Function()"),
    (r"\b(setTimeout|setInterval)\s*\(\s*[\"'\x60]", "code-execution", "error", "Unsafe code execution: string argument to a timer"), (r"document\.writeln\s*\(", "code-execution", "error", "Unsafe code execution: document.writeln()"),
))
RUBY = _group("ruby", ".rb .rake", (
    (r"\beval\s*\(", "ruby-eval", "error", "Use of eval() allows arbitrary code execution"), (r"\b(system|exec)\s*\(", "ruby-command-injection", "warning", "Shell command execution — verify input is not user-controlled"),
    (r"\.send\s*\(\s*(params|request|input)", "ruby-unsafe-send", "error", "Dynamic method dispatch with user input via send()", r"(?i)#"),
    (r"\bKernel\.open\s*\(", "ruby-kernel-open", "warning", "Kernel.open() can execute shell commands via pipe character", r"Kernel\.open\s*\(\s*[\"']"), (r"\bYAML\.load\b", "ruby-yaml-load", "warning", "YAML.load() can deserialize arbitrary Ruby objects", r"YAML\.load_file"),
    (r"\bMarshal\.load\s*\(", "ruby-marshal-load", "warning", "Marshal.load() deserializes arbitrary Ruby objects from untrusted data"),
))
GO = _group("go", ".go", (
    (r"\bhttp\.ListenAndServe\s*\(", "go-no-tls", "warning", "http.ListenAndServe serves traffic without TLS encryption"),
    (r"exec\.Command\s*\([^)]*\+", "go-command-injection", "warning", "Potential command injection: exec.Command with string concatenation", r"exec\.Command\s*\(\s*\"[^\"]*\"\s*\)"),
    (r"exec\.Command\s*\(\s*[a-zA-Z_]", "go-command-injection", "warning", "Potential command injection: exec.Command with variable argument", r"exec\.Command\s*\(\s*\"[^\"]*\""),
    (r"&http\.Server\s*\{", "go-no-timeout", "info", "HTTP server created without explicit timeout configuration", r"(?i)(ReadTimeout|WriteTimeout|IdleTimeout)"),
))
PYTHON = _group("python", ".py", (
    (r"\bpickle\.(load|loads)\s*\(", "python-pickle", "warning", "Insecure deserialization: pickle.load() can execute arbitrary code"),
    (r"\bsubprocess\.(call|Popen|run|check_call|check_output)\s*\([^)]*shell\s*=\s*True", "python-shell-injection", "warning", "Potential command injection: subprocess with shell=True"),
    (r"\byaml\.load\s*\(", "python-unsafe-yaml", "warning", "Insecure YAML loading: yaml.load() without SafeLoader can execute arbitrary code", r"Loader\s*=\s*(yaml\.)?SafeLoader", r"yaml\.safe_load"),
))
SCRIPT = _group("ts", ".ts .tsx .js .jsx .mjs .cjs", (
    (r"child_process\.exec\s*\(\s*`", "ts-command-injection", "warning", "Potential command injection: child_process.exec with template literal"), (r"child_process\.exec\s*\([^)]*\+", "ts-command-injection", "warning", "Potential command injection: child_process.exec with string concatenation"),
    (r"\brequire\s*\(\s*[a-zA-Z_$]", "ts-dynamic-require", "warning", "Dynamic require() with variable argument may load untrusted modules", r"\brequire\s*\(\s*[\"']"),
    (r"__proto__\s*[=\[]", "ts-prototype-pollution", "warning", "Potential prototype pollution: __proto__ assignment"), (r"constructor\.prototype\s*[=\[]", "ts-prototype-pollution", "warning", "Potential prototype pollution: constructor.prototype assignment"),
))
KOTLIN = _group("kotlin", ".kt .kts", (
    (r"ObjectInputStream\s*\(", "deserialization", "error", "Potential insecure deserialization: ObjectInputStream on untrusted data"), (r"Runtime\.getRuntime\(\)\.exec\s*\(", "command-injection", "error", "Potential command injection via Runtime.exec()"),
    (r"ProcessBuilder\s*\(\s*[a-zA-Z]", "command-injection", "error", "Potential command injection via ProcessBuilder with variable argument", r"ProcessBuilder\s*\(\s*\"[^\"]*\"\s*\)"),
    (r"(?i)(password|passwd|secret|apiKey|api_key)\s*=\s*\"[^\"]{8,}\"", "hardcoded-secret", "error", "Hardcoded credential detected in Kotlin code", r"(?i)System\.getenv\(", _NOT_REAL),
))
CSHARP = _group("csharp", ".cs", (
    (r"BinaryFormatter", "deserialization", "error", "BinaryFormatter is insecure and can lead to remote code execution via deserialization"), (r"Process\.Start\s*\([^)]*\+", "command-injection", "error", "Potential command injection: Process.Start with string concatenation"),
    (r"\$\"(?i)(SELECT|INSERT|UPDATE|DELETE|DROP|ALTER)\b[^\"]*\{", "sql-injection", "error", "Potential SQL injection: string interpolation in SQL query"), (r"\[AllowAnonymous\]", "allow-anonymous", "warning", "[AllowAnonymous] attribute detected — verify this endpoint should be publicly accessible"),
))
PHP = _group("php", ".php", (
    (r"\beval\s*\(\s*\$", "code-execution", "error", "eval() with variable input allows arbitrary code execution"), (r"\b(exec|system|shell_exec|passthru|popen|proc_open)\s*\(", "command-injection", "error", "Command execution function detected — verify input is not user-controlled"),
    (r"preg_replace\s*\(\s*['\"][^'\"]*/e\b", "code-execution", "error", "preg_replace with /e modifier allows code execution (deprecated since PHP 5.5)"), (r"\bunserialize\s*\(\s*\$_(GET|POST|REQUEST|COOKIE|SERVER)", "deserialization", "error", "Insecure deserialization: unserialize() on user input"),
    (r"\b(include|require|include_once|require_once)\s*\(\s*\$", "file-inclusion", "error", "File inclusion with variable path — potential local/remote file inclusion"), (r"mysqli_query\s*\(\s*\$\w+\s*,\s*[\"'][^\"']*[\"']\s*\.", "sql-injection", "error", "Potential SQL injection: string concatenation in mysqli_query()", r"\?"),
    (r"\$_(GET|POST|REQUEST)\s*\[", "input-validation", "warning", "Direct use of superglobal — validate and sanitize before use", "htmlspecialchars", "htmlentities", "filter_input", "filter_var", "intval", r"\(int\)"),
))
SWIFT = _group("swift", ".swift", (
    (r"NSKeyedUnarchiver\s*\(", "swift-insecure-deserialization", "error", "NSKeyedUnarchiver without requiresSecureCoding may allow insecure deserialization", "requiresSecureCoding"), (r"\w+!\.[a-zA-Z]", "swift-force-unwrap", "warning", "Force unwrap (!) on optional may crash at runtime"),
    (r"\btry!\s", "swift-force-try", "warning", "Force try (try!) will crash on error instead of handling it"), (r"\bUnsafe(?:Mutable)?(?:Raw)?Pointer\b", "swift-unsafe-pointer", "warning", "Unsafe pointer usage bypasses Swift's memory safety guarantees"),
))
C = _group("c", ".c .h .cpp .cc .cxx .hpp .hxx", (
    (r"\bgets\s*\(", "c-banned-function", "error", "Banned function gets() is vulnerable to buffer overflow"), (r"\bstrcpy\s*\(", "c-buffer-overflow", "error", "strcpy() is vulnerable to buffer overflow", r"\bstrncpy\s*\("), (r"\bstrcat\s*\(", "c-buffer-overflow", "error", "strcat() is vulnerable to buffer overflow", r"\bstrncat\s*\("),
    (r"\bsprintf\s*\(", "c-buffer-overflow", "error", "sprintf() is vulnerable to buffer overflow", r"\bsnprintf\s*\("), (r"\bsystem\s*\(", "c-command-injection", "warning", f"system() {_CMD}"), (r"\bpopen\s*\(", "c-command-injection", "warning", f"popen() {_CMD}"),
))
CPP = _group("cpp", ".cpp .cc .cxx .hpp .hxx", (
    (r"\bnew\s+", "cpp-raw-new", "warning", "Raw new without smart pointer context — potential memory leak", r"(make_unique|make_shared|unique_ptr|shared_ptr)"), (r"\breinterpret_cast\b", "cpp-unsafe-cast", "warning", "reinterpret_cast is an unsafe cast that bypasses type safety"),
    (r"\bconst_cast\b", "cpp-const-cast", "warning", "const_cast removes const safety guarantees"),
))
OBJC = _group("objc", ".m .mm", (
    (r"NSKeyedUnarchiver", "objc-insecure-deserialization", "error", "NSKeyedUnarchiver without requiresSecureCoding may allow insecure deserialization", "requiresSecureCoding"),
    (r"stringWithFormat:\s*[a-zA-Z_]", "objc-format-string", "warning", "Potential format string vulnerability: stringWithFormat with variable (not literal) format", r"stringWithFormat:\s*@\""), (r"\bNSLog\s*\(", "objc-information-disclosure", "info", "NSLog() may disclose sensitive information in production logs"),
))
BASH = _group("bash", ".sh .bash", (
    (r"\beval\s+", "bash-code-injection", "error", "eval allows arbitrary code injection"), (r"curl.*\|\s*(sh|bash)", "bash-pipe-to-shell", "error", "Piping curl output to shell is dangerous — executes arbitrary remote code"),
    (r"chmod\s+777\b", "bash-overly-permissive", "warning", "chmod 777 sets overly permissive file permissions"), (r"chmod.*o\+w", "bash-world-writable", "warning", "Setting world-writable permissions is a security risk"),
))
SQL = _group("sql", ".sql", (
    (r"(?i)\bGRANT\s+ALL\b", "sql-overly-permissive", "warning", "GRANT ALL is overly permissive — grants all privileges"), (r"(?i)\bDROP\s+TABLE\b", "sql-drop-without-guard", "warning", "DROP TABLE without IF EXISTS may cause errors if table does not exist", r"(?i)IF\s+EXISTS"),
    (r"(?i)\bEXECUTE\s+IMMEDIATE\b", "sql-dynamic-execution", "warning", "EXECUTE IMMEDIATE with dynamic SQL is vulnerable to injection"), (r"(?i)\bxp_cmdshell\b", "sql-command-execution", "error", "xp_cmdshell allows operating system command execution from SQL Server"),
))
DART = _group("dart", ".dart", (
    (r"Process\.(run|start)\s*\(", "dart-command-execution", "warning", "Process.run/Process.start executes system commands — verify input is not user-controlled"), (r"import\s+['\"]dart:mirrors['\"]", "dart-reflection", "warning", "dart:mirrors import enables reflection which can be abused for code injection"),
    (r"\bHttpClient\s*\(", "dart-insecure-http", "info", "HttpClient created without explicit certificate validation", r"(?i)(certificate|badCertificateCallback|SecurityContext)"),
))
SCALA = _group("scala", ".scala", (
    (r"Runtime\.getRuntime\(\)\.exec\s*\(", "scala-command-injection", "error", "Potential command injection via Runtime.exec()"), (r"scala\.sys\.process", "scala-process-injection", "warning", "scala.sys.process with string interpolation may be vulnerable to command injection"),
    (r"XML\.load\s*\(", "scala-xxe", "warning", "XML.load() may be vulnerable to XXE (XML External Entity) attacks"), (r"ObjectInputStream\s*\(", "scala-deserialization", "error", "Potential insecure deserialization: ObjectInputStream on untrusted data"),
))
R_LANG = _group("r", ".r .rmd", (
    (r"\bsystem\s*\(", "r-command-execution", "warning", f"system() {_CMD}"), (r"\bsystem2\s*\(", "r-command-execution", "warning", f"system2() {_CMD}"), (r"\beval\s*\(\s*parse\s*\(\s*text\s*=", "r-code-injection", "error", "eval(parse(text=...)) allows arbitrary code injection"),
    (r"\breadRDS\s*\(\s*url\s*\(", "r-unsafe-deserialization", "warning", "Loading serialized R objects from URLs may execute arbitrary code"),
))
ELIXIR = _group("elixir", ".ex .exs", (
    (r"Code\.eval_string\s*\(", "elixir-code-injection", "error", "Code.eval_string() allows arbitrary code injection"), (r"System\.cmd\s*\(", "elixir-command-injection", "warning", "System.cmd() executes system commands — verify input is not user-controlled"), (r":os\.cmd\s*\(", "elixir-command-execution", "warning", ":os.cmd() executes operating system commands"),
))
LUA = _group("lua", ".lua", (
    (r"\bloadstring\s*\(", "lua-code-execution", "error", "loadstring() compiles and can execute arbitrary Lua code"), (r"\bload\s*\(", "lua-code-execution", "error", "load() compiles and can execute arbitrary Lua code", r"\bloadstring\s*\("),
    (r"\bos\.execute\s*\(", "lua-command-execution", "warning", "os.execute() runs operating system commands — verify input is not user-controlled"), (r"\bio\.popen\s*\(", "lua-command-execution", "warning", "io.popen() runs operating system commands — verify input is not user-controlled"),
    (r"\bdebug\.getinfo\s*\(", "lua-introspection", "info", "debug.getinfo() enables runtime introspection which can be abused"),
))
ZIG = _group("zig", ".zig", (
    (r"@ptrCast\b", "zig-unsafe-cast", "warning", "@ptrCast is an unsafe pointer cast that bypasses type safety"), (r"@alignCast\b", "zig-unsafe-cast", "warning", "@alignCast is an unsafe alignment cast"), (r"@intToPtr\b", "zig-unsafe-cast", "warning", "@intToPtr converts an integer to a pointer — potential for memory corruption"),
    (r"std\.c\.system\b", "zig-command-execution", "error", "std.c.system() executes shell commands — vulnerable to command injection"), (r"allowzero\b", "zig-allowzero", "warning", "allowzero pointer permits null dereference"),
))
NIM = _group("nim", ".nim", (
    (r"\{\.emit:", "nim-code-injection", "error", "{.emit:} pragma injects raw code into the output — potential for code injection"), (r"\{\.importc\.\}", "nim-ffi", "info", "{.importc.} imports C functions without type safety guarantees"), (r"\bunsafeAddr\b", "nim-unsafe-addr", "warning", "unsafeAddr bypasses Nim's memory safety guarantees"),
    (r"\bcast\[", "nim-unsafe-cast", "warning", "cast[] performs an unsafe type cast bypassing the type system"), (r"\bexecCmd\b", "nim-command-execution", "warning", f"execCmd() {_CMD}"),
))
CRYSTAL = _group("crystal", ".cr", (
    (r"Process\.run\b", "crystal-command-execution", "warning", "Process.run executes system commands — verify input is not user-controlled"), (r"\bsystem\s*\(", "crystal-command-execution", "warning", "system() executes shell commands — vulnerable to command injection"),
    (r"IO\.popen\b", "crystal-command-execution", "warning", f"IO.popen {_CMD}"), (r"\bmacro\s+", "crystal-macro", "info", "Macros generate code at compile time and can be difficult to audit"),
))
VLANG = _group("vlang", ".v", (
    (r"\bunsafe\s*\{", "vlang-unsafe-block", "warning", "unsafe block bypasses V's memory safety guarantees"), (r"C\.system\s*\(", "vlang-command-execution", "error", "C.system() executes shell commands — vulnerable to command injection"), (r"#flag\b", "vlang-ffi", "info", "#flag directive modifies compiler flags — can introduce unsafe C dependencies"), (r"#include\b", "vlang-ffi", "info", "#include directive includes C header files — ensure they are trusted"),
    (r"v\.reflection\b", "vlang-reflection", "warning", "v.reflection enables runtime reflection which can be abused"),
), SLASHES)
DLANG = _group("dlang", ".d", (
    (r"__traits\s*\(\s*getMember", "dlang-reflection", "warning", "__traits(getMember) uses runtime reflection which can be abused"), (r"std\.process\.execute\b", "dlang-command-execution", "warning", "std.process.execute runs system commands — verify input is not user-controlled"),
    (r"\bmixin\s*\(", "dlang-code-injection", "warning", "mixin() evaluates strings as D code — potential for code injection"), (r"cast\s*\(\s*void\s*\*\s*\)", "dlang-unsafe-cast", "warning", "cast(void*) erases type information — potential for memory corruption"), (r"@system\b", "dlang-system-code", "info", "@system attribute marks code as unsafe — allows pointer arithmetic and casts"),
))
HASKELL = _group("haskell", ".hs .lhs", (
    (r"\bunsafePerformIO\b", "haskell-unsafe-io", "error", "unsafePerformIO breaks referential transparency and can cause subtle bugs"), (r"\bunsafeCoerce\b", "haskell-unsafe-coerce", "error", "unsafeCoerce bypasses type safety entirely"), (r"System\.Process", "haskell-command-injection", "warning", "System.Process can execute arbitrary system commands"),
    (r"\bunsafeDupablePerformIO\b", "haskell-unsafe-io", "error", "unsafeDupablePerformIO is even more dangerous than unsafePerformIO"), (r"\bunsafeInterleaveIO\b", "haskell-unsafe-io", "warning", "unsafeInterleaveIO creates lazy I/O which can cause resource leaks"),
), DASHES)

JULIA = _group("julia", ".jl", (
    (r"\beval\s*\(", "julia-code-injection", "error", "eval executes arbitrary Julia code"), (r"\brun\s*\(", "julia-command-injection", "warning", "run() executes system commands"),
    (r"\bccall\s*\(", "julia-unsafe-ccall", "warning", "ccall invokes C functions directly"), (r"\bunsafe_\w+", "julia-unsafe-operation", "warning", "Unsafe operation bypasses safety checks"),
), HASH)
SOLIDITY = _group("solidity", ".sol", (
    (r"\.call\{value:", "solidity-reentrancy", "error", "External call with value transfer is vulnerable to reentrancy"), (r"tx\.origin", "solidity-tx-origin", "error", "tx.origin for authorization is vulnerable to phishing"),
    (r"selfdestruct\s*\(", "solidity-selfdestruct", "error", "selfdestruct can permanently destroy the contract"), (r"delegatecall\s*\(", "solidity-delegatecall", "warning", "delegatecall executes code in the caller's context"),
    (r"block\.timestamp", "solidity-timestamp-dependence", "warning", "block.timestamp can be manipulated by miners"),
), r"^\s*//")
TERRAFORM = _group("terraform", ".tf .tfvars", (
    (r"cidr_blocks\s*=\s*\[\s*\"0\.0\.0\.0/0\"\s*\]", "terraform-open-cidr", "warning", "Security group allows traffic from all IPs"), (r"(?i)password\s*=\s*\"[^\"]+\"", "terraform-hardcoded-secret", "error", "Hardcoded password in Terraform config"),
    (r"(?i)secret\s*=\s*\"[^\"]+\"", "terraform-hardcoded-secret", "error", "Hardcoded secret in Terraform config"), (r"encrypted\s*=\s*false", "terraform-unencrypted", "warning", "Resource encryption is disabled"),
), SLASH_HASH)
FORTRAN = _group("fortran", ".f90 .f95 .f03 .f08 .f .for", (
    (r"(?i)\bCALL\s+SYSTEM\s*\(", "fortran-command-injection", "error", "CALL SYSTEM executes OS commands"), (r"(?i)\bEQUIVALENCE\s*\(", "fortran-equivalence", "warning", "EQUIVALENCE allows memory aliasing abuse"),
    (r"(?i)\bFORMAT\s*\(.*\bA\b", "fortran-format-injection", "warning", "FORMAT with character input may allow format string injection"), (r"(?i)\bOPEN\s*\(.*FILE\s*=\s*['\"][^'\"]+['\"]\s*", "fortran-hardcoded-path", "warning", "Hardcoded file path in OPEN statement"),
), BANG)
PROTOBUF = _group("protobuf", ".proto", (
    (r"option\s+java_package\s*=\s*\".*\.(internal|impl)\b", "protobuf-internal-package", "warning", "java_package references internal package"),
    (r"\bservice\s+\w+\s*\{", "protobuf-unauthenticated-service", "warning", "Service defined without authentication annotation", r"(?i)(auth|authenticated|interceptor)"), (r"\bgoogle\.protobuf\.Any\b", "protobuf-any-type", "warning", "google.protobuf.Any allows arbitrary types (type confusion risk)"),
), r"^\s*//")
CLOJURE = _group("clojure", ".clj .cljs .cljc .edn", (
    (r"\(eval\s", "clojure-code-injection", "error", "eval allows arbitrary code execution"), (r"\(read-string\s", "clojure-code-injection", "error", "read-string can execute arbitrary code via reader macros"),
    (r"clojure\.java\.shell/sh\b", "clojure-command-injection", "warning", "sh executes system commands — verify input is not user-controlled"), (r"\(resolve\s", "clojure-reflection", "warning", "resolve enables dynamic var lookup which can be abused"),
), SEMICOLON)
ERLANG = _group("erlang", ".erl .hrl", (
    (r"os:cmd\s*\(", "erlang-command-injection", "error", "os:cmd executes shell commands"), (r"erlang:apply\s*\(", "erlang-dynamic-apply", "warning", "erlang:apply with dynamic module/function can execute arbitrary code"),
    (r"file:eval\s*\(", "erlang-code-injection", "error", "file:eval evaluates arbitrary Erlang expressions from file"), (r"erl_eval:expr", "erlang-code-injection", "error", "erl_eval allows arbitrary expression evaluation"),
), PERCENT)
FSHARP = _group("fsharp", ".fs .fsx .fsi", (
    (r"System\.Diagnostics\.Process", "fsharp-command-injection", "warning", "System.Diagnostics.Process executes system commands"), (r"Assembly\.Load", "fsharp-reflection", "warning", "Assembly.Load enables dynamic code loading"),
    (r"Unchecked\.defaultof", "fsharp-null-ref", "warning", "Unchecked.defaultof creates null references bypassing F# null safety"), (r"NativePtr\.\w+", "fsharp-unsafe-pointer", "warning", "NativePtr operations bypass memory safety"),
), r"^\s*//")
OCAML = _group("ocaml", ".ml .mli", (
    (r"Sys\.command\b", "ocaml-command-injection", "error", "Sys.command executes shell commands"), (r"Unix\.system\b", "ocaml-command-injection", "error", "Unix.system executes shell commands via /bin/sh"),
    (r"Obj\.magic\b", "ocaml-unsafe-cast", "error", "Obj.magic bypasses the type system entirely"), (r"Marshal\.from_string\b", "ocaml-deserialization", "warning", "Marshal.from_string can deserialize arbitrary data unsafely"),
), OCAML_MARK)
VISUAL_BASIC = _group("vb", ".vb .vbs", (
    (r"(?i)\bShell\s*\(", "vb-shell-injection", "error", "Shell() executes system commands"), (r"(?i)\bProcess\.Start\s*\(", "vb-process-start", "warning", "Process.Start executes external programs"),
    (r"(?i)\bMy\.Computer\.FileSystem\.(Delete|Write)", "vb-filesystem-access", "warning", "Direct filesystem operation"), (r"(?i)\bCreateObject\s*\(", "vb-createobject", "warning", "CreateObject can instantiate arbitrary COM objects"),
), QUOTE)
COBOL = _group("cobol", ".cob .cbl .cpy", (
    (r"(?i)\bCALL\s+['\"]SYSTEM['\"]\s+USING", "cobol-system-call", "error", "CALL 'SYSTEM' executes OS commands"), (r"(?i)\bACCEPT\s+\w+\s+FROM\s+ENVIRONMENT", "cobol-env-access", "warning", "ACCEPT FROM ENVIRONMENT reads env variables"),
    (r"(?i)\b(STRING|UNSTRING)\b", "cobol-string-overflow", "warning", "STRING/UNSTRING without ON OVERFLOW may silently truncate", r"(?i)\bON\s+OVERFLOW\b"), (r"(?i)\bREDEFINES\b", "cobol-redefines-mismatch", "warning", "REDEFINES on different-length fields can cause data corruption"),
), COBOL_MARK)
ADA = _group("ada", ".adb .ads", (
    (r"(?i)\bUnchecked_Conversion\b", "ada-unchecked-conversion", "warning", "Unchecked_Conversion bypasses type safety"), (r"(?i)\bUnchecked_Deallocation\b", "ada-unchecked-deallocation", "warning", "Unchecked_Deallocation can cause dangling pointers"),
    (r"(?i)\bSystem\.Address\b", "ada-raw-address", "warning", "System.Address bypasses type safety"), (r"(?i)pragma\s+Suppress\s*\(\s*All_Checks", "ada-suppress-checks", "error", "Suppressing all checks removes runtime safety"),
), DASHES)
PASCAL = _group("pascal", ".pas .pp .dpr .lpr", (
    (r"(?i)\bExecuteProcess\s*\(", "pascal-execute-process", "error", "ExecuteProcess runs external commands"), (r"(?i)\bShellExecute\s*\(", "pascal-shell-execute", "error", "ShellExecute runs external programs"),
    (r"(?i)\bGetMem\s*\(", "pascal-getmem", "warning", "GetMem allocates unmanaged memory"), (r"(?i)\b(?:absolute|Pointer)\b", "pascal-unsafe-pointer", "warning", "Direct pointer usage bypasses type safety"),
), PASCAL_MARK)
PERL = _group("perl", ".pl .pm", (
    (r"\beval\s*\(", "perl-code-injection", "error", "eval executes arbitrary code"), (r"\bsystem\s*\(", "perl-command-injection", "error", "system() executes shell commands"),
    (r"\bopen\s*\(.*\|", "perl-command-injection", "error", "open with pipe executes commands"), (r"`[^`]+`", "perl-command-injection", "warning", "Backtick execution runs shell commands"),
), HASH)
POWERSHELL = _group("powershell", ".ps1 .psm1 .psd1", (
    (r"(?i)Invoke-Expression", "powershell-code-injection", "error", "Invoke-Expression executes arbitrary code"), (r"(?i)Start-Process", "powershell-command-execution", "warning", "Start-Process launches external processes"),
    (r"(?i)ConvertTo-SecureString.*-AsPlainText", "powershell-plaintext-secret", "warning", "Converting plaintext to SecureString exposes secrets in code"), (r"(?i)\$ExecutionContext\.InvokeCommand", "powershell-code-injection", "error", "InvokeCommand enables dynamic code execution"),
), HASH)
GROOVY = _group("groovy", ".groovy .gvy .gradle", (
    (r"\.execute\(\)", "groovy-command-injection", "error", "String.execute() runs system commands"), (r"(?i)GroovyShell\b", "groovy-code-injection", "error", "GroovyShell enables dynamic code execution"),
    (r"(?i)Eval\s*\(", "groovy-code-injection", "error", "Eval executes arbitrary Groovy code"), (r"Runtime\.getRuntime\(\)\.exec", "groovy-command-injection", "error", "Runtime.exec executes system commands"),
), r"^\s*//")

LANGUAGES = (JAVA, RUST, SCRIPT_EXECUTION, RUBY, GO, PYTHON, SCRIPT, KOTLIN, CSHARP, PHP, SWIFT, C, CPP, OBJC, BASH, SQL, DART, SCALA, R_LANG, ELIXIR, LUA, ZIG, NIM, CRYSTAL, VLANG, DLANG, HASKELL, JULIA, SOLIDITY, TERRAFORM, FORTRAN, PROTOBUF, CLOJURE, ERLANG, FSHARP, OCAML, VISUAL_BASIC, COBOL, ADA, PASCAL, PERL, POWERSHELL, GROOVY)
