"""Code snippets from which the test corpora are put together (own text, ASCII)."""

SNIPPETS = (
    'password = "hunter22secret"',
    'api_key = "k1234567890abcdef"',
    'db_pwd: "changeme-please"',
    'access_token = "tok_live_123456789"',
    'key = "sk-abcdefghijklmnopqrstuvwxyz012345"',
    'token = "ghp_abcdefghijklmnopqrstuvwxyz0123456789"',
    '# -----BEGIN RSA PRIVATE KEY-----',
    'url = "jdbc:postgres://admin:pw12@db.local/x"',
    'cursor.execute(f"select * from t where id={uid}")',
    'db.query("SELECT * FROM users WHERE id=" + uid)',
    'cursor.execute("select %s from t" % col)',
    'rows = Model.objects.raw(f"select 1")',
    'os.system("ls " + path)',
    'out = os.popen(cmd)',
    'subprocess.run(cmd, shell=True)',
    'child_process.exec("ls " + dir)',
    'exec("rm -rf")',
    'result = eval(expression)',
    'except:',
    'except Exception:',
    'try:\n    risky()\nexcept ValueError:\n    pass',
    'def collect(items=[], extra=None):\n    return items',
    'if value == None:',
    'while True:\n    queue.append(item)',
    'while True:\n    if done: break',
    'assert total > 0',
    'data = pickle.loads(blob)',
    'digest = hashlib.md5(data)',
    'app.run(host, debug=True)',
    'cfg = yaml.load(stream)',
    'pick = random.choice(options)',
    'def getUserName(user):\n    return user.name',
    'class widget_factory(object):\n    size = 4\n    def make(self):\n        return 1',
    'MyValue = compute()',
    'for part in parts:\n    text += "x"',
    'if type(x) == int:',
    'total = sum([v * 2 for v in values])',
    'for u in users:\n    name = u.name\n    db.query(u.id)',
    'for u in users:\n    global counter\n    counter += 1',
    'timeout = 86400',
    'LIMIT = 4096',
    'return None',
    'import os',
    'from os import path',
    'name = conf.get(key).strip()',
    'last = items[len(items)]',
    'if a === b || c == d {',
    'Promise.all(tasks)',
    'counter = start + 1;',
    'if (x === NaN) {',
    'for (var i = 0; i < n; i++) {',
    'setTimeout("tick()", 500)',
    'box.innerHTML = input',
    'box.outerHTML = input',
    'document.write(userText)',
    'el.insertAdjacentHTML("beforeend", html)',
    'const f = new Function("a", body)',
    'obj["__proto__"] = payload',
    'location.href = next',
    'function load_user_data(id) {',
    'var legacy = true;',
    'load().then(function (r) { use(r) })',
    'for (const a of b) { document.querySelector(a) }',
    'list.forEach(print)',
    'localStorage.setItem("k", v)',
    'console.log("debug", state)',
    'async function pull() { const r = await api.get(u); }',
    'fetch(endpoint)',
    'setInterval(poll, 1000)',
    'button.addEventListener("click", go)',
    'user!.name.first',
    'let payload: any = load()',
    'const v = raw as Widget',
    'const city = user?.address.city',
    'merge({...req.body})',
    'export function render(view) {',
    'interface shape {',
    'enum Color { red_one = 1 }',
    'fs.writeFileSync(p, d)',
    '_ = conn.Close()',
    'for i, v := range rows { go func() { use(v) }() }',
    'n := int(myint64val)',
    'for k := range m { defer f.Close() }',
    'exec.Command("sh", "-c", script)',
    'tls := &Config{InsecureSkipVerify: true}',
    'import "math/rand"',
    'http.ListenAndServe(addr, nil)',
    'func Handle_All(w Writer) {',
    'type Server struct {',
    'func (s VeryLongServerName) Run() {',
    'xs := []int{}',
    'panic("unreachable")',
    'let v = parse(s).unwrap();',
    'let w = open(p).expect("open");',
    'let small = big as u8;',
    'unsafe { *ptr }',
    'let t = mem::transmute(x);',
    'Command::new("sh")',
    'let c = data.clone();',
    'let mut s = String::new();\ns.push_str("a");',
    'fn readAll(path: &str) {',
    'todo!()',
    'unimplemented!()',
    'value = map.get(id).toString();',
    'if (name == "admin") {',
    'try { go(); } catch (Exception e) { }',
    'int port = Integer.parseInt(arg);',
    'Runtime.getRuntime().exec(cmd);',
    'new ObjectInputStream(in);',
    'MessageDigest.getInstance("MD5");',
    'public void Process(String a) {',
    'static final int maxSize = 10;',
    'for (int i = 0; i < n; i++) { s += "x"; }',
    'for (Item it : items) { Node q = new Node(); }',
    'user.update(params[:user])',
    'rescue Exception => e',
    'obj.send(params[:method])',
    'User.where("name = #{name}")',
    'system("rm #{file}")',
    'def fetchAll',
    'x = 1  ',
    'users.each { |u| Post.find(u.id) }',
    '(bool ok, ) = to.call{value: v}("");\nbalance[msg.sender] = 0;',
    'uint256 total = a + b;',
    'require(tx.origin == owner);',
    'uint t = block.timestamp;',
    'selfdestruct(owner);',
    'target.delegatecall(data);',
    'uint r = uint(blockhash(block.number - 1));',
    'function withdraw(uint amt) external {',
    'function pay(address to) { Item storage it = items[to]; }',
    'for (uint i = 0; i < list.length; i++) {',
    '# TODO: tidy this up',
    '// FIXME broken on leap years',
    '// HACK around cache',
    '# XXX check later',
    'if kind == 3 and (flag or other):',
    'elif kind == 4:',
    'x = sorted(scores)[0]',
    'if items.count() > 0:',
    '}',
    'this_line_is_long = "' + "abcdefghij " * 12 + '"',
    '',
    'y = rows[i + 1]',
    'if isinstance(x, (A, B)):',
    'items = []\nfor x in xs:\n    items.append(x)',
    'if isinstance(a, B):\n    one()\nelif isinstance(a, C):\n    two()\nelif isinstance(a, D):\n    three()',
    'import { useState } from "react"',
    'class Panel extends View {',
    'export const show = (a) => {',
    'public class Main {',
    'import java.util.List;',
    'public static void main(String[] args) {',
    'fn total(a: i32) -> i32 {\n    if a > 1 && a < 9 { return a; }\n    a\n}',
    'for a in b:\n    for c in d:\n        for e in f:\n            use(a[c + 1])',
)
