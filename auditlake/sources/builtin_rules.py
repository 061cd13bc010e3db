"""The shipped detection rules (fixed values: ids, texts and patterns in file order of their ids)."""

from __future__ import annotations

#: id, name, severity, language, category, cwe, pattern; the one structural rule has a query instead.
RULES: list[dict] = [
    {"id": "code-injection", "name": "Code Injection Detection", "description": "检测代码注入风险：动态代码执行", "severity": "critical", "language": "all", "category": "injection", "cwe": "CWE-94", "pattern": r"""(?i)(eval\s*\(|exec\s*\(|Function\s*\(|setTimeout\s*\(\s*['"]|setInterval\s*\(\s*['"]|new\s+Function|vm\.runInNewContext|vm\.runInThisContext|vm\.runInContext|child_process\.exec|spawn|execSync|execFile|Runtime\.getRuntime\(\)\.exec|ProcessBuilder|GroovyShell|ScriptEngineManager|ScriptEngine|invokeMethod|invoke|createScript|eval\$\{|@eval|<%.*eval|%>)"""},
    {"id": "command-injection", "name": "Command Injection Detection", "description": "检测命令注入风险：用户输入直接用于命令执行", "severity": "critical", "language": "all", "category": "injection", "cwe": "CWE-78", "pattern": r"""(?i)(Runtime\.getRuntime\(\)\.exec|ProcessBuilder|exec\(|system\(|popen\(|shell_exec\(|passthru\(|eval\s*\(|`[^`]+`)\s*\(.*\+|exec\s*\(\s*['"][^'"]*\$)"""},
    {"id": "csrf-detection", "name": "CSRF Detection", "description": "检测CSRF风险：缺少CSRF保护的表单或API端点", "severity": "medium", "language": "all", "category": "authentication", "cwe": "CWE-352", "pattern": r"""(?i)(@PostMapping|@RequestMapping|form.*action|\.post\(|\.ajax\(|fetch\(|XMLHttpRequest).*(?!\bcsrf\b|\btoken\b|\b_csrf\b|\bX-CSRF\b|\bXSRF\b)"""},
    {"id": "debug-info-leak", "name": "Debug Information Disclosure", "description": "检测调试信息泄露：包含调试信息的代码", "severity": "low", "language": "all", "category": "information-disclosure", "cwe": "CWE-215", "pattern": r"""(?i)(console\.log|console\.debug|console\.warn|console\.error|print|println|debugger|debug\.print|System\.out\.print|System\.err\.print|trace|alert\(|console\.trace|console\.table|console\.dir)"""},
    {"id": "insecure-cookie", "name": "Insecure Cookie Configuration", "description": "检测不安全的Cookie设置：缺少Secure或HttpOnly标志", "severity": "medium", "language": "all", "category": "session-management", "cwe": "CWE-614", "pattern": r"""(?i)(setCookie|cookie|Cookie|set_header.*Set-Cookie|response\.addCookie)(?!.*\bSecure\b|.*\bHttpOnly\b|.*\bSameSite\b)"""},
    {"id": "insecure-random", "name": "Insecure Random Number Generation", "description": "检测不安全的随机数生成：使用弱随机数生成器", "severity": "medium", "language": "all", "category": "cryptography", "cwe": "CWE-330", "pattern": r"""(?i)(Math\.random\(\)|java\.util\.Random|rand\(\)|random\(\)|srand\(\)|arc4random\(\)|mt_rand\(\))"""},
    {"id": "ldap-injection", "name": "LDAP Injection Detection", "description": "检测LDAP注入风险：用户输入直接用于LDAP查询", "severity": "high", "language": "java", "category": "injection", "cwe": "CWE-90", "pattern": r"""(?i)(DirContext|InitialDirContext|LdapContext|search\(|lookup\().*\+.*filter|searchControls.*filter.*\+"""},
    {"id": "log-injection", "name": "Log Injection Detection", "description": "检测日志注入风险：用户输入未经过滤直接写入日志", "severity": "medium", "language": "all", "category": "injection", "cwe": "CWE-117", "pattern": r"""(?i)(logger\.|log\.|Logger\.|console\.log|console\.error|print|println|printf|System\.out\.print|System\.err\.print).*\+.*request|.*log.*\+.*user|.*log.*\+.*input|.*log.*\+.*param"""},
    {"id": "no-console-log", "name": "No Console Log", "description": "Detects usage of console.log which should not be in production code.", "severity": "low", "language": "typescript", "category": None, "cwe": "CWE-489", "pattern": None, "query": "(call_expression function: (member_expression object: (identifier) @obj property: (property_identifier) @prop) (#eq? @obj \"console\") (#eq? @prop \"log\"))"},
    {"id": "no-hardcoded-passwords", "name": "No Hardcoded Passwords", "description": "Detects hardcoded passwords in code.", "severity": "high", "language": "all", "category": None, "cwe": "CWE-798", "pattern": r"""(?i)password\s*=\s*['"][^'"]+['"]"""},
    {"id": "path-traversal", "name": "Path Traversal Detection", "description": "检测路径遍历风险：用户输入直接用于文件路径操作", "severity": "high", "language": "all", "category": "file-operation", "cwe": "CWE-22", "pattern": r"""(?i)(new\s+File\(|FileInputStream|FileReader|FileWriter|FileOutputStream|Files\.read|Files\.write|Path\.of|Paths\.get|open\(|fopen\(|readfile\(|file_get_contents\(|include|require).*\+|File\s*\(.*request|path\s*=\s*.*request|filename\s*=\s*.*request"""},
    {"id": "sensitive-info-leak", "name": "Sensitive Information Disclosure", "description": "检测敏感信息泄露：硬编码的API密钥、令牌、凭证", "severity": "high", "language": "all", "category": "information-disclosure", "cwe": "CWE-200", "pattern": r"""(?i)(api_key|apikey|secret|token|credential|password|passwd|pwd|private_key|privatekey|auth_token|access_token|session_token|refresh_token)\s*=\s*['"][^'\"]{10,}['"]"""},
    {"id": "sensitive-log-data", "name": "Sensitive Data in Logs", "description": "检测敏感信息记录到日志：密码、密钥等敏感信息被记录", "severity": "medium", "language": "all", "category": "information-disclosure", "cwe": "CWE-532", "pattern": r"""(?i)(logger\.|log\.|Logger\.|console\.log|print|println|printf|System\.out\.print|System\.err\.print).*\b(password|passwd|pwd|secret|token|api_key|apikey|private_key|privatekey|credit_card|ssn|social_security|auth|credential)\b"""},
    {"id": "unsafe-deserialization", "name": "Unsafe Deserialization", "description": "检测不安全的反序列化：使用不安全的反序列化方法", "severity": "critical", "language": "all", "category": "security-misconfiguration", "cwe": "CWE-693", "pattern": r"""(?i)(ObjectInputStream|readObject|readUnshared|XMLDecoder|XStream|Yaml\.load|pickle\.loads|pickle\.load|marshal\.loads|marshal\.load|unpickle|unserialize|json\.decode|JSON\.parse|MessagePack\.unpack|protobuf\.ParseFromString|\.Deserialize|\.FromBinary|\.ParseFrom)"""},
    {"id": "unsafe-http-methods", "name": "Unsafe HTTP Methods Detection", "description": "检测不安全的HTTP方法：允许危险的HTTP方法", "severity": "medium", "language": "all", "category": "security-misconfiguration", "cwe": "CWE-650", "pattern": r"""(?i)(@RequestMapping.*method.*=.*RequestMethod\.(PUT|DELETE|TRACE|OPTIONS|PATCH)|allowMethods|allowedMethods|httpMethodAllowed|httpMethodsAllowed).*(PUT|DELETE|TRACE|OPTIONS|PATCH)"""},
    {"id": "unsafe-redirect", "name": "Unsafe Redirect Detection", "description": "检测不安全的重定向：基于用户输入的开放重定向", "severity": "high", "language": "all", "category": "security-misconfiguration", "cwe": "CWE-601", "pattern": r"""(?i)(response\.sendRedirect|header\s*\(\s*['"]Location|location\.href|window\.location|response\.redirect|redirect\(|\.forward\().*\+|redirect.*request\.|sendRedirect.*request\.|Location.*request\."""},
    {"id": "weak-encryption", "name": "Weak Encryption Algorithm", "description": "检测不安全的加密算法：使用弱加密算法如DES、RC4等", "severity": "high", "language": "all", "category": "cryptography", "cwe": "CWE-327", "pattern": r"""(?i)(Cipher\.getInstance|SecretKeySpec|KeyGenerator|createCipher|encrypt|decrypt).*['"](DES|RC4|RC2|Blowfish|ECB|None|PKCS5Padding)['"]"""},
    {"id": "xxe-detection", "name": "XXE Detection", "description": "检测XXE风险：不安全的XML解析器配置", "severity": "critical", "language": "all", "category": "injection", "cwe": "CWE-611", "pattern": r"""(?i)(DocumentBuilderFactory|SAXParser|XMLReader|XmlReader|XmlDocument|XmlTextReader|XDocument|XmlParser|XmlParse|parseXml|loadXml).*(?!\bsetFeature\b.*\bexternal-general-entities\b.*false|setFeature.*external-parameter-entities.*false|setFeature.*disallow-doctype-decl.*true|expandEntityReferences.*false)"""},
]
