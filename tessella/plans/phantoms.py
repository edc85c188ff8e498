"""Imports of packages that exist nowhere: what each language knows by itself, and how its imports name packages.

An import is known if one of its names (the whole, its first part, its leading parts, and spellings of them) is in
the language's own list or among the manifests' packages. Without manifests nothing is reported, except for the
languages that need none.
"""
from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import paths

# fixed values: standard packages by language
STANDARD = {
    "rust": "std core alloc proc_macro crate super self",
    "typescript": "assert buffer child_process cluster console constants crypto dgram dns domain events fs http http2 https module net os path perf_hooks process punycode querystring readline repl stream string_decoder sys timers tls tty url util v8 vm wasi worker_threads zlib fs/promises path/posix path/win32 test",
    "php": "PHP Ds FFI Fiber Random IntlException App Src Tests Test Database Modules Domain Http Console",
    "swift": "Foundation UIKit SwiftUI Combine CoreData CoreGraphics CoreLocation MapKit AVFoundation CoreImage CoreML Metal SceneKit SpriteKit ARKit RealityKit Observation Swift _Concurrency os AppKit WatchKit WidgetKit GameKit StoreKit CloudKit WebKit SafariServices AuthenticationServices CryptoKit Network NaturalLanguage Vision CoreBluetooth CoreMotion CoreTelephony CoreText Dispatch ObjectiveC Darwin XCTest",
    "ruby": "abbrev base64 benchmark bigdecimal cgi cmath coverage csv date dbm debug delegate digest drb english erb etc expect fcntl fiber fiddle fileutils find forwardable gdbm getoptlong io/console io/nonblock io/wait ipaddr irb json logger matrix minitest monitor mutex_m net/ftp net/http net/imap net/pop net/smtp nkf objspace observer open-uri open3 openssl optparse ostruct pathname pp prettyprint prime pstore psych pty racc readline reline resolv ripper rss ruby2_keywords securerandom set shellwords singleton socket stringio strscan syslog tempfile time timeout tmpdir tracer tsort un unicode_normalize uri weakref webrick yaml zlib thread rbconfig mkmf rubygems bundler bundler/setup rake",
    "c": "assert.h complex.h ctype.h errno.h fenv.h float.h inttypes.h iso646.h limits.h locale.h math.h setjmp.h signal.h stdalign.h stdarg.h stdatomic.h stdbool.h stddef.h stdint.h stdio.h stdlib.h stdnoreturn.h string.h tgmath.h threads.h time.h uchar.h wchar.h wctype.h unistd.h fcntl.h sys/types.h sys/stat.h sys/socket.h sys/wait.h sys/mman.h sys/time.h sys/ioctl.h sys/select.h netinet/in.h arpa/inet.h netdb.h pthread.h dirent.h dlfcn.h poll.h semaphore.h termios.h syslog.h grp.h pwd.h",
    "cpp": "algorithm any array atomic barrier bit bitset cassert ccomplex cctype cerrno cfenv cfloat charconv chrono cinttypes climits clocale cmath codecvt compare complex concepts condition_variable coroutine csetjmp csignal cstdarg cstddef cstdint cstdio cstdlib cstring ctgmath ctime cuchar cwchar cwctype deque exception execution expected filesystem format forward_list fstream functional future initializer_list iomanip ios iosfwd iostream istream iterator latch limits list locale map memory memory_resource mutex new numbers numeric optional ostream print queue random ranges ratio regex scoped_allocator semaphore set shared_mutex source_location span spanstream sstream stack stacktrace stdexcept stop_token streambuf string string_view strstream syncstream system_error thread tuple type_traits typeindex typeinfo unordered_map unordered_set utility valarray variant vector version",
    "objc": "Foundation UIKit AppKit CoreGraphics CoreFoundation CoreData CoreLocation MapKit AVFoundation CoreImage CoreML Metal SceneKit SpriteKit ARKit RealityKit QuartzCore CoreAnimation CoreText CoreBluetooth CoreMotion CoreTelephony CoreMedia CoreAudio CoreVideo Security SystemConfiguration CFNetwork Accelerate GameKit StoreKit CloudKit WebKit SafariServices AuthenticationServices CryptoKit Network Dispatch ObjectiveC Darwin XCTest os MobileCoreServices AddressBook AssetsLibrary AudioToolbox MediaPlayer MessageUI EventKit Contacts ContactsUI HealthKit HomeKit MultipeerConnectivity NotificationCenter Photos PhotosUI Social WatchConnectivity",
    "dart": "dart:async dart:collection dart:convert dart:core dart:developer dart:io dart:isolate dart:math dart:mirrors dart:typed_data dart:ffi dart:html dart:js dart:js_util",
    "scala": "scala java javax", "groovy": "groovy java javax org.codehaus.groovy",
    "r": "base compiler datasets grDevices graphics grid methods parallel splines stats stats4 tcltk tools utils boot class cluster codetools foreign KernSmooth lattice MASS Matrix mgcv nlme nnet rpart spatial survival",
    "elixir": "Enum String Map List Keyword IO File Path GenServer Supervisor Agent Task Registry DynamicSupervisor Kernel Module Process Node System Code Macro Protocol Stream Range Regex URI Base Bitwise DateTime NaiveDateTime Date Time Calendar Tuple MapSet Access Atom Integer Float Function Port StringIO OptionParser EEx Logger Application Config Mix ExUnit IEx GenEvent Collectable Enumerable Inspect Exception Behaviour",
    "lua": "table string math io os debug coroutine package utf8 bit32",
    "zig": "std builtin std.mem std.fmt std.fs std.io std.net std.http std.json std.math std.os std.debug std.heap std.time std.testing std.crypto std.rand std.log std.sort std.unicode std.process std.Thread std.ArrayList std.AutoHashMap std.StringHashMap", "nim": "system os strutils sequtils tables sets algorithm math json httpclient asyncdispatch net streams unicode parseutils times threadpool locks channels macros sugar options strformat re nre osproc parseopt terminal unittest logging hashes marshal std",
    "crystal": "comparable enumerable io file dir http json yaml socket process regex time random math spec log option channel fiber mutex xml csv base64 digest openssl uri uuid benchmark colorize html markdown mime",
    "vlang": "os math json net net.http sync time io crypto rand arrays strings encoding regex log cli flag term datatypes dl builtin v.ast v.fmt v.parser v.reflection compress crypto.md5 crypto.sha256 encoding.csv encoding.utf8 net.urllib net.websocket",
    "dlang": "std core etc",
    "haskell": "Prelude Data.List Data.Map Data.Map.Strict Data.Set Data.Maybe Data.Either Data.Char Data.String Data.Word Data.Int Data.Tuple Data.IORef Data.Typeable Data.ByteString Data.ByteString.Lazy Data.Text Data.Text.IO Control.Monad Control.Monad.IO.Class Control.Applicative Control.Concurrent Control.Exception Control.DeepSeq System.IO System.Environment System.Exit System.FilePath System.Directory System.Process GHC.Generics GHC.IO GHC.Base Debug.Trace Text.Read Text.Show Foreign Foreign.C Foreign.Ptr",
    "clojure": "clojure", "fsharp": "System System.IO System.Collections System.Collections.Generic System.Linq System.Text System.Threading System.Threading.Tasks System.Net System.Net.Http System.Diagnostics System.Runtime Microsoft.FSharp.Core Microsoft.FSharp.Collections FSharp.Core FSharp.Collections",
    "ocaml": "Stdlib List Array String Bytes Buffer Printf Format Hashtbl Map Set Sys Unix Filename Arg Lexing Parsing Scanf Obj Gc Lazy Fun In_channel Out_channel Seq Option Result Either Int Float Bool Char Complex Uchar Random Printexc Digest Marshal",
    "perl": "strict warnings Carp Exporter File::Basename File::Path File::Spec File::Find File::Copy File::Temp Getopt::Long Getopt::Std Data::Dumper Storable POSIX Cwd Scalar::Util List::Util Encode IO::File IO::Socket Socket Time::HiRes Time::Local Digest::MD5 Digest::SHA MIME::Base64 JSON::PP HTTP::Tiny Test::More Test::Simple FindBin lib constant vars utf8 overload parent base feature",
    "powershell": "Microsoft.PowerShell.Management Microsoft.PowerShell.Utility Microsoft.PowerShell.Security Microsoft.PowerShell.Archive Microsoft.PowerShell.Host Microsoft.PowerShell.Diagnostics PSReadLine PackageManagement PowerShellGet ThreadJob Microsoft.WSMan.Management ActiveDirectory PSDesiredStateConfiguration",
    "julia": "Base Core Main LinearAlgebra Statistics Random Dates Printf REPL Test Pkg Sockets Distributed SharedArrays SparseArrays DelimitedFiles Markdown UUIDs InteractiveUtils Logging Serialization Unicode TOML Libdl Profile",
    "solidity": "@openzeppelin hardhat forge-std", "protobuf": "google/protobuf google/api",
}
# fixed values: prefixes of packages that are often made up
MADE_UP = {
    "java": "java.utils. java.collections. java.strings. javax.json.bind. java.concurrent. java.http. java.logging. org.spring.",
    "kotlin": "java.utils. java.collections. java.strings. javax.json.bind. java.concurrent. java.http. java.logging. org.spring.",
    "csharp": "System.Collections.Generics. System.Collection. System.Util. System.Utils. System.Networking. System.Threading.Task. System.Text.Jsons. Microsoft.AspNet.",
}


@dataclass(frozen=True)
class Naming:
    """How a language's imports name packages: the separator of parts, which leading runs count, what is relative."""

    separator: str = "."
    parts: str = "exact top"
    relative: str = r"^\."
    severity: str = "error"
    needs_manifest: bool = True


NAMING = {
    "go": Naming("/", "prefix", r"^\.|^[^./]+(/|$)"), "typescript": Naming("/", "exact top prefix", r"^[./]"), "python": Naming(".", "top"), "rust": Naming("::", "top"), "php": Naming("\\", "top prefix"), "swift": Naming(".", "exact top"), "ruby": Naming("/", "exact top"),
    "c": Naming("/", "exact top"), "cpp": Naming("/", "exact top"), "objc": Naming("/", "exact top"), "dart": Naming("/", "exact top", r"^\.|^(?!dart:|package:)\w+:|^[^:]*$"), "scala": Naming(".", "prefix"), "groovy": Naming(".", "prefix"), "r": Naming(".", "exact"), "elixir": Naming(".", "exact top"),
    "lua": Naming(".", "top"), "zig": Naming(".", "exact top", r"^\.|\.zig$"), "nim": Naming("/", "exact top"), "crystal": Naming("/", "exact top"), "vlang": Naming(".", "exact top"), "dlang": Naming(".", "exact top"), "haskell": Naming(".", "exact top"), "clojure": Naming(".", "exact prefix"),
    "fsharp": Naming(".", "exact top"), "ocaml": Naming(".", "exact top"), "perl": Naming("::", "exact top"), "powershell": Naming(".", "exact", r"^[./\\]|\.ps(m|d)?1$", "warning", False), "julia": Naming(".", "exact top", r"^\.|\.jl$"), "solidity": Naming("/", "top", r"^\.", "warning", False), "protobuf": Naming("/", "prefix", r"^\.", "warning", False),
}


def _names(path: Column, naming: Naming) -> Column:
    """All names under which an import may be known."""
    clean = F.regexp_replace(path, r"^(node:|package:)|(\._|\.\*)$", "")
    runs = []
    if "exact" in naming.parts:
        runs.append(F.array(clean))
    if "top" in naming.parts:
        runs.append(F.array(F.substring_index(clean, naming.separator, 1)))
    if "prefix" in naming.parts:
        runs.append(paths.prefixes(clean, naming.separator))
    every = F.flatten(F.array(*runs))
    spelled = F.flatten(F.array(every, F.transform(every, F.lower), F.transform(every, lambda x: F.translate(x, "_", "-")), F.transform(every, lambda x: F.translate(F.lower(x), "-", "_"))))
    return F.array_distinct(spelled)


def phantom_imports(imports: DataFrame, packages: DataFrame | None, own: DataFrame | None = None) -> DataFrame:
    """Rows of ``imports`` (lang, path, ...) that are known nowhere, with ``severity``.

    ``packages`` (key, and langs where told) are those of the manifests: with ``langs`` a language is asked only if it has
    a manifest of its own. ``own`` (key) the repository's top folders and modules. Languages
    without a rule are left alone; a null path is no import.
    """
    spark = imports.sparkSession
    rows = imports.where("path is not null and path <> ''").withColumn("__id", F.monotonically_increasing_id())
    listed = [(lang, w) for lang, words in STANDARD.items() for w in words.split()] + [("python", w) for w in sorted(sys.stdlib_module_names)] + [("cpp", w) for w in STANDARD["c"].split()] + [("objc", w) for w in STANDARD["c"].split()]
    known = spark.createDataFrame(listed, "k_lang string, k_key string")
    names, relative, severity, asks = F.lit(None).cast("array<string>"), F.lit(False), F.lit("error"), F.lit(True)
    for lang, n in NAMING.items():
        here = F.col("lang") == lang
        names = F.when(here, _names(F.col("path"), n)).otherwise(names)
        relative = F.when(here, F.col("path").rlike(n.relative)).otherwise(relative)
        severity = F.when(here, F.lit(n.severity)).otherwise(severity)
        asks = F.when(here, F.lit(n.needs_manifest)).otherwise(asks)
    asked = rows.where(F.col("lang").isin(*NAMING)).withColumn("severity", severity).withColumn("__asks", asks).where(~relative)
    if packages is not None and "langs" in packages.columns:
        asked = asked.where(~F.col("__asks")).unionByName(asked.where("__asks").join(packages.select(F.explode("langs").alias("lang")).distinct(), "lang", "left_semi").select(*asked.columns))
    elif packages is None or packages.isEmpty():
        asked = asked.where(~F.col("__asks"))
    each = asked.select("__id", F.col("lang"), F.explode(names).alias("key"))
    hits = each.join(known, (each["lang"] == known["k_lang"]) & (each["key"] == known["k_key"]), "left_semi").select("__id")
    for more in (packages, own):
        if more is not None:
            hits = hits.unionByName(each.join(more.select("key").distinct(), "key", "left_semi").select("__id"))
    unknown = asked.join(hits.distinct(), "__id", "left_anti").drop("__asks", "__id")
    made_up = F.lit(False)
    for lang, words in MADE_UP.items():
        for w in words.split():
            made_up = made_up | ((F.col("lang") == lang) & F.concat("path", F.lit(".")).startswith(w))
    return unknown.unionByName(rows.where(F.col("lang").isin(*MADE_UP) & made_up).withColumn("severity", F.lit("error")).drop("__id"))
